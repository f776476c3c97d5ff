"""Patches, selection, grids, collation, the stored name index, snapshots, pruned search and keyed state, against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.functions.text import fuzzy_ratio, locale_order, matching_share, natural_order
from cardloom.operators import detections, evaluate, library, sampling, search, vectors, views
from cardloom.operators.selection import exact_quantiles
from cardloom.operators.vectors import places
from cardloom.sources import shared, snapshots
from cardloom.streaming.scans import held_scans, rocksdb_state

LIBRARY = "card_id string, scryfall_id string, name string, set_code string, collector_number string, foil boolean, count long, created_at timestamp, updated_at timestamp, ord long, photo string"


def day(n):
    return dt.datetime(2020, 1, n)


def card(card_id, scryfall_id, foil, count, ord_):
    return (card_id, scryfall_id, "n " + card_id, "s", "1", foil, count, day(1), day(1), ord_, None)


# --- patches


def patch(spark, rows):
    """rows: card_id, n, and the fields that are set."""
    kinds = {"scryfall_id": "string", "name": "string", "set_code": "string", "collector_number": "string", "foil": "boolean", "count": "long", "created_at": "timestamp"}
    schema = "card_id string, n long, now timestamp, " + ", ".join(f"set_{k} boolean, {k} {t}" for k, t in kinds.items())
    return spark.createDataFrame([(c, n, day(n), *[x for k in kinds for x in (k in s, s.get(k))]) for c, n, s in rows], schema)


def test_several_patches_of_one_card(spark):
    held = spark.createDataFrame([card("a", "1", False, 1, 1), card("b", "2", False, 1, 2), card("c", "3", True, 4, 3)], LIBRARY)
    changes = patch(spark, [("a", 2, {"count": 2}), ("a", 4, {"foil": True}), ("a", 3, {"count": 3, "name": "x"}), ("a", 5, {}), ("b", 2, {"scryfall_id": "9"}), ("b", 3, {"scryfall_id": None}), ("c", 9, {}), ("zz", 2, {"count": 5})])
    got = {r.card_id: r for r in library.update_cards(held, changes, "n").collect()}
    assert len(got) == 3
    assert (got["a"]["count"], got["a"]["name"], got["a"]["foil"], got["a"]["updated_at"]) == (3, "x", True, day(4))
    assert got["b"]["scryfall_id"] is None and got["b"]["updated_at"] == day(3)
    assert got["c"]["updated_at"] == day(1) and got["c"]["count"] == 4


def test_changes_keep_the_printing_rule(spark):
    held = spark.createDataFrame([card(f"k{i}", str(i // 2), i % 2 == 0, 1, i) for i in range(20)], LIBRARY)
    changes = patch(spark, [(f"k{i}", n, {"foil": n % 2 == 0} if n < 4 else {"scryfall_id": "3"}) for i in range(0, 20, 3) for n in (2, 3, 4)] * 50)
    after = library.change_cards(held, changes, "n").cache()
    assert library.check_printing_rule(after).count() == 0
    assert after.count() == after.select("card_id").distinct().count()
    assert after.agg(F.sum("count")).first()[0] == 20


# --- selection and cells


@pytest.mark.parametrize("accuracy", [7, 60, 50_000])
def test_exact_quantiles(spark, accuracy):
    r = np.random.default_rng(accuracy)
    groups = {"few": [3.0], "ties": r.integers(0, 4, 501).astype(float).tolist(), "wide": (10.0 ** r.uniform(-300, 300, 800)).tolist(), "two": [1.0, 2.0], None: r.normal(size=333).tolist()}
    rows = [(g, x) for g, v in groups.items() for x in v] + [("few", None), ("none", None)]
    fractions = {"low": 0.0, "p5": 0.05, "half": 0.5, "p95": 0.95, "high": 1.0}
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {x.g: tuple(x)[1:] for x in exact_quantiles(df, "x", fractions, "g", accuracy=accuracy).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(v, list(fractions.values()))), rel=1e-12)
    every = [x for v in groups.values() for x in v]
    one = exact_quantiles(df, "x", fractions, accuracy=accuracy).collect()
    assert tuple(one[0]) == pytest.approx(tuple(np.quantile(every, list(fractions.values()))), rel=1e-12)
    assert exact_quantiles(df.limit(0), "x", fractions).collect() == []


def test_quantiles_keep_no_buffer_of_values(spark):
    plan = exact_quantiles(spark.range(10).select(F.col("id").cast("double").alias("x")), "x", {"m": 0.5})._jdf.queryExecution().toString()
    assert "percentile_approx" in plan and "percentile(" not in plan and "collect_set" not in plan


def test_threshold_grid_joins_no_rows(spark):
    r = random.Random(1)
    rows = [(r.choice([0.3, 0.5, 0.65, 0.9, 1.0, r.random()]), r.choice([0.0, 0.02, 0.07, 0.3, -0.1]), r.random() < 0.97) for _ in range(3000)] + [(None, 0.1, True), (0.9, None, None)]
    df = spark.createDataFrame(rows, "top1_sim double, name_gap double, top1_name boolean")
    out = evaluate.threshold_grid(df, 90.0)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for s in evaluate.SIMS:
        for g in evaluate.GAPS:
            hit = [x for x in rows if x[0] is not None and x[1] is not None and x[0] >= s and x[1] >= g]
            known = [x[2] for x in hit if x[2] is not None]
            if known and 100 * sum(known) / len(known) >= 90:
                want[s, g] = (len(hit), round(100 * sum(known) / len(known), 4), round(100 * len(hit) / len(rows), 4))
    assert {(x.sim, x.gap): (x.qualified, x.accuracy, x.coverage) for x in out.collect()} == want and want


# --- boxes


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image_id long, det_id long, cx double, cy double, w double, h double, angle double, conf double")


def test_overlapping_pairs_equal_nested_loop(spark):
    r = random.Random(7)
    rows = [(i, d, r.uniform(-50, 50), r.uniform(-50, 50), s := 2.0 ** r.uniform(-8, 7), s * r.uniform(0.1, 1), r.choice([0.0, 0.7]), 0.5) for i in range(3) for d in range(70)]
    rows += [(0, 100, 0.0, 0.0, 16.0, 16.0, 0.0, 0.5), (0, 101, 0.0, 0.0, 16.0, 16.0, 0.0, 0.5), (0, 102, 16.0, 0.0, 16.0, 16.0, 0.0, 0.5), (0, 103, math.nan, 0.0, 1.0, 1.0, 0.0, 0.5), (0, 104, 0.0, 0.0, math.inf, 1.0, 0.0, 0.5)]
    rows += [(0, 105, 1e15, 1e15, 1e-7, 1e-7, 0.0, 0.5), (0, 106, 1e15, 1e15, 8.0, 8.0, 0.0, 0.5), (0, 107, 0.0, 0.0, 0.0, 5.0, 0.0, 0.5)]
    want = {}

    def edges(x):
        c, s = abs(math.cos(x[6])), abs(math.sin(x[6]))
        hw, hh = (x[4] * c + x[5] * s) / 2, (x[4] * s + x[5] * c) / 2
        return x[2] - hw, x[3] - hh, x[2] + hw, x[3] + hh

    for p in rows:
        for q in rows:
            a, b = edges(p), edges(q)
            if p[0] == q[0] and p[1] < q[1] and all(map(math.isfinite, a + b)):
                both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
                if both > 0:
                    want[p[0], p[1], q[1]] = both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)
    got = detections.pairwise_iou(boxes(spark, rows)).collect()
    assert len(got) == len(want) and {(x.image_id, x.a, x.b) for x in got} == set(want)
    assert all(x.iou == pytest.approx(want[x.image_id, x.a, x.b], rel=1e-9) for x in got)


def test_an_image_of_many_boxes(spark):
    n = 100_000
    at = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("det_id"), (F.col("id") % 400 * 3.0).alias("cx"), (F.floor(F.col("id") / 400) * 3.0).alias("cy"))
    dets = at.select("*", F.lit(4.0).alias("w"), F.lit(2.0).alias("h"), F.lit(0.0).alias("angle"), F.lit(0.5).alias("conf"))
    assert detections.pairwise_iou(dets).count() == 250 * 399  # each meets its neighbour on the right


# --- text


def test_matching_blocks_equal_difflib(spark):
    r = random.Random(4)
    text = lambda kinds, n: "".join(r.choice(kinds) for _ in range(r.randrange(n + 1)))
    pairs = [(text("ab", 12), text("ab", 12)) for _ in range(300)] + [(x := text("abcdefgh é😀", 40), x[3:] + text("xyz", 9)) for _ in range(300)]
    pairs += [(text("abcde ", 300), text("abcdefghij ,.", 450)) for _ in range(30)] + [("", ""), ("a", ""), ("same", "same")]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert matching_share([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx(want, abs=1e-12)
    rows = spark.createDataFrame([*[(i, a, b) for i, (a, b) in enumerate(pairs)], (-1, None, "x"), (-2, "x", None)], "i long, a string, b string")
    got = {x.i: (x.whole, x.least) for x in rows.select("i", fuzzy_ratio("a", "b").alias("whole"), fuzzy_ratio("a", "b", F.lit(0.6)).alias("least")).collect()}
    assert got[-1] == got[-2] == (None, None)
    for i, w in enumerate(want):
        assert got[i][0] == pytest.approx(w, abs=1e-12)
        assert got[i][1] == pytest.approx(w, abs=1e-12) if w >= 0.6 else got[i][1] < 0.6


def test_names_in_a_readers_order(spark):
    # As a reader's language has them: punctuation, digits, letters; accents after plain letters, small before capital.
    order = ["-a", "1 a", "10 a", "2 a", "a", "A", "á", "Á", "ab", "Ábc", "æon", "b", "Jötun", "Jotun Grunt", "jötun grunt", "Jötun Owl", "z"]
    rows = spark.createDataFrame([(x,) for x in reversed(order)], "name string")
    assert [x.name for x in places(rows, locale_order(F.col("name"))).orderBy("place").collect()] == order
    numbers = ["2a", "10", "10a", "Á9", "a10", "b 2", "b 10", "ö1", "p"]
    rows = spark.createDataFrame([(x,) for x in sorted(numbers)], "name string")
    assert [x.name for x in rows.orderBy(natural_order(F.col("name"))).collect()] == numbers
    same = spark.createDataFrame([("Éowyn 07", "eowyn 7"), ("Éowyn 07", "eowyn 8")], "a string, b string")
    assert [x[0] for x in same.select(natural_order(F.col("a")) == natural_order(F.col("b"))).collect()] == [True, False]


def test_options_in_order(spark):
    rows = [("s1", "Zed", "Émile", 1), ("s2", "éa", "Anna", 2), ("s3", "Eb", "anna", 3), ("s4", None, "Anna", 4), ("s2", "other", "Émile", 5), (None, "x", "", 6)]
    cards = spark.createDataFrame(rows, "set_code string, set_name string, artist string, ord long")
    assert [(x.value, x.label, x.n) for x in views.set_options(cards).orderBy("place").collect()] == [("s2", "éa", 2), ("s3", "Eb", 1), ("s4", "S4", 1), ("s1", "Zed", 1)]
    assert [(x.value, x.n) for x in views.artist_options(cards).orderBy("place").collect()] == [("Anna", 2), ("Émile", 2), ("anna", 1)]


# --- search


def test_search_over_a_stored_index(spark, tmp_path):
    r = random.Random(3)
    parts = ["Jötun", "Grunt", "of", "the", "Sky", "Éowyn", "10", "2", "ab", "æon", "a", "Ölm", "night"]
    rows = [(p, f"id{p % 290}", " ".join(r.choice(parts) for _ in range(r.randrange(1, 4))), r.choice(["neo", "S2", "s10"]), str(r.randrange(30)), r.choice(["en", None, "ja"])) for p in range(300)]
    catalog = spark.createDataFrame(rows, "pos long, scryfall_id string, name string, set_code string, collector_number string, lang string")
    asked = ["jö", "JÖTUN", "night", "the sky", "neo 7", "s2/12", "zzz", "a", "  of ", "ab", "10", "qqq night"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = search.build_name_index(catalog, f"file://{tmp_path}/index")
    found = search.search_names(queries, search.open_name_index(spark, f"file://{tmp_path}/index"), 20)
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.query_id, x.place)):
        got.setdefault(x.query_id, []).append(x.pos)
    ordered = [x.pos for x in catalog.orderBy(*[natural_order(F.col(c)) for c in ("name", "set_code", "collector_number")], "pos").collect()]
    place = {p: i for i, p in enumerate(ordered)}
    for i, text in enumerate(asked):
        q = text.strip().lower()
        if len(q) < 2:
            assert i not in got
            continue
        code = q.replace("/", " ").split(" ")
        first = {}
        for p, sid, _, s, n, lang in rows:
            if len(code) == 2 and s.lower() == code[0] and n == code[1] and sid not in first:
                first[sid] = (lang not in (None, "en"), p)
        rank = lambda name: 0 if name == q else 1 if name.startswith(q) else 2 if " " + q in name else 3 if q in name else -1
        hits = sorted((rank(name.lower()), place[p], p) for p, sid, name, *_ in rows if sid not in first and rank(name.lower()) >= 0)
        assert got.get(i, []) == ([p for _, p in sorted(first.values())] + [h[2] for h in hits])[:20]
    # The plan of a query reads postings, and makes no runs of the catalogue's names.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 4 and "positions" in plan and "substring(lower" not in plan
    assert {x.query_id: x.n for x in search.count_found(queries, index).collect()} == {x.query_id: x.n for x in search.search_names(queries, index, 10_000).groupBy("query_id").agg(F.count("*").alias("n")).collect()}


# --- the seeded sample


def test_draws_equal_the_generator(spark):
    for seed in (0, 1, 123456789, (1 << 32) - 1):
        a, want = seed & 0xFFFFFFFF, []
        for _ in range(300):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            want.append((t ^ (t >> 14)) / 4294967296)
        got = [x[0] for x in spark.range(300).orderBy("id").select(sampling.nth_draw(F.col("id"), seed)).collect()]
        assert got == want
    rows = spark.range(40).select(F.col("id").alias("pos"), F.concat(F.lit("f"), "id").alias("filename"))
    some = sampling.parity_sample(rows, rows.filter("pos % 3 = 0"), 30, seed=7).collect()
    assert len(some) == 30 and all(x.pos % 3 == 0 for x in some) and [x.draw for x in some] == sorted({x.draw for x in some})
    assert sampling.parity_sample(rows, rows.limit(0), 30).count() == 0


# --- snapshots and scratch


def test_a_snapshot_is_in_force_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    assert snapshots.snapshot(spark, path) is None
    one = snapshots.write_snapshot(spark.range(5), path, None)
    assert (one.number, one.rows) == (1, 5)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_switch", killed)
        with pytest.raises(KeyboardInterrupt):
            snapshots.write_snapshot(spark.range(9), path, 1)
    assert snapshots.read_snapshot(spark, path).count() == 5
    broken = spark.range(9).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        snapshots.write_snapshot(broken, path, 1)
    assert snapshots.read_snapshot(spark, path).count() == 5 and len(os.listdir(tmp_path / "table/data")) <= 2
    spark.range(9).write.parquet(f"{path}/data/half-written")  # a writer that died before its switch
    assert snapshots.write_snapshot(spark.range(7), path, 1).number == 2
    assert snapshots.read_snapshot(spark, path).count() == 7 and snapshots.read_snapshot(spark, path, 1).count() == 5


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    snapshots.write_snapshot(spark.range(5), path, None)
    snapshots.write_snapshot(spark.range(6), path, 1)
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(spark.range(8), path, 1)
    seen = snapshots.snapshots
    with monkeypatch.context() as m:  # both have looked before either has switched
        m.setattr(snapshots, "snapshots", lambda s, p: [n for n in seen(s, p) if n < 3] if not seen(s, p)[2:] else seen(s, p))
        snapshots.write_snapshot(spark.range(7), path, 2)
        m.setattr(snapshots, "snapshots", lambda s, p, looks=iter([True]): [1, 2] if next(looks, False) else seen(s, p))
        with pytest.raises(snapshots.SnapshotConflict):
            snapshots.write_snapshot(spark.range(8), path, 2)
    assert snapshots.read_snapshot(spark, path).count() == 7
    assert snapshots.forget_snapshots(spark, path, keep=1) == [1, 2] and snapshots.snapshots(spark, path) == [3]
    assert len(os.listdir(tmp_path / "table/data")) == 1


def test_scratch_holds_only_results(spark, tmp_path):
    base = shared.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    with shared.scratch(spark, "list"):
        places(spark.range(50), F.desc("id")).write.parquet(f"file://{tmp_path}/out")
    assert set(os.listdir(base)) == before and spark.read.parquet(f"file://{tmp_path}/out").count() == 50
    table = shared.kept(spark.range(3), "table")
    assert len(set(os.listdir(base)) - before) == 1
    shared.discard(table)
    assert set(os.listdir(base)) == before


def test_a_table_is_made_once_and_again_if_it_is_gone(spark):
    made = []

    def make(path):
        made.append(path)
        spark.range(2).write.parquet(path)

    first = shared.made_once(spark, "thing", ("k",), make)
    assert shared.made_once(spark, "thing", ("k",), make) == first and len(made) == 1
    assert shared.made_once(spark, "thing", ("other",), make) != first
    shared.delete(spark, first)
    again = shared.made_once(spark, "thing", ("k",), make)
    assert again != first and spark.read.parquet(again).count() == 2 and len(made) == 3


# --- pruned search


def test_pruned_search_skips_blocks_and_is_exact(spark, tmp_path):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + 0.05 * r.normal(size=(120, 16)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = x[8]  # equal vectors tie
    index = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "pos long, embedding array<float>")
    queries = index.filter("pos % 40 = 7").select(F.col("pos").alias("query_id"), "embedding").unionByName(spark.createDataFrame([(-1, [0.0] * 16)], "query_id long, embedding array<float>"))
    blocked = vectors.block_index(index, f"file://{tmp_path}/b", 24)
    for k in (1, 5, 300, 5000):
        want = sorted(map(tuple, vectors.topk(queries, index, k).collect()))
        assert sorted(map(tuple, vectors.topk_pruned(queries, blocked, k).collect())) == want
    read = vectors.blocks_read(queries.filter("query_id >= 0"), blocked, 5).first()
    assert read.needed < read.pairs / 3 and read.needed_rows < read.rows / 3


# --- keyed state


def test_scans_over_a_held_collection(spark, tmp_path):
    kinds = "card_id string, scryfall_id string, foil boolean, count long, created_at timestamp, ord long"
    held = spark.createDataFrame([("h", "1", False, 5, day(1), 0), ("z", "9", False, 5, day(1), 0)], kinds)
    seen, states = [], []

    def run(rows, n):
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"file://{tmp_path}/in/batch={n}")
        stream = held_scans(spark.readStream.schema(kinds).parquet(f"file://{tmp_path}/in/batch=*"), held)
        out = stream.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state")
        done = out.foreachBatch(lambda batch, _: seen.extend(tuple(x) for x in batch.collect())).trigger(availableNow=True).start()
        done.awaitTermination()
        states.append(sum(s["numRowsTotal"] for s in done.lastProgress["stateOperators"]))

    with rocksdb_state(spark):
        run([("a", "1", False, 1, day(3), 1), ("b", "1", False, 2, day(2), 2), ("a", "1", False, 1, day(3), 1), ("c", "2", True, 1, day(4), 3), ("d", None, True, 1, day(4), 9)], 1)
        assert sorted(seen) == [("1", False, 8, day(3), "h", 0), ("2", True, 1, day(4), "c", 3)]
        del seen[:]
        run([("a", "1", False, 1, day(3), 1), ("h", "1", False, 5, day(1), 0), ("e", "2", True, 1, day(5), 5)], 2)
        assert seen == [("2", True, 2, day(5), "c", 3)]  # what came again changes nothing
    assert states[-1] <= 3 + 6  # a row per printing, an id per scan
