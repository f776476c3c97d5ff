"""Golden examples of the operators, as small tables."""

from __future__ import annotations

import random
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.functions import text as X
from cardloom.functions import vectors as V
from cardloom.operators import catalog, detections, imports, library, profile, sampling, search, vectors, views
from cardloom.sources import bulk, csv, files
from cardloom.streaming.scans import fold_scans

LIB = "card_id string, scryfall_id string, name string, set_code string, collector_number string, foil boolean, count long, created_at timestamp, updated_at timestamp, ord long, photo string"


def at(year: int) -> datetime:
    return datetime(year, 1, 1)


def card(card_id, item="x", foil=False, count=1, year=2020, ord=0, photo=None, name="Bolt", number="1"):
    return (card_id, item, name, "m11", number, foil, count, at(year), at(year), ord, photo)


def lib(spark, *rows):
    return spark.createDataFrame(list(rows), LIB)


def test_topk(spark):
    index = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "pos long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.1, 0.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.pos for r in vectors.topk(q, index, 2).orderBy("rank").collect()] == [0, 1]
    assert [r.pos for r in vectors.topk(q, index, 9).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert vectors.topk(q, index, 0).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vectors.topk(q, spark.createDataFrame([(0, [1.0])], "pos long, embedding array<float>"), 1).collect()


def test_topk_takes_queries_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=8).tolist()) for i in range(200)]
    index = spark.createDataFrame(rows, "pos long, embedding array<float>")
    q = index.select(F.col("pos").alias("query_id"), "embedding")
    whole = sorted(tuple(x) for x in vectors.topk(q, index, 3, leave_out=True).collect())
    monkeypatch.setattr(vectors, "QUERY_BYTES", 64 * 70)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 64 * 30)
    monkeypatch.setattr(vectors, "CELLS", 500)
    assert sorted(tuple(x) for x in vectors.topk(q, index, 3, leave_out=True).collect()) == whole
    assert all(x[0] != x[2] for x in whole) and len(whole) == 600


def test_rotation_retry(spark):
    index = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "pos long, embedding array<float>")
    hits = lambda v: vectors.topk(spark.createDataFrame([(1, v)], "query_id long, embedding array<double>"), index, 1)
    best = lambda t: vectors.best_orientation(hits([0.6, 0.8]), hits([1.0, 0.0]), t).first().pos
    assert best(0.9) == 0 and best(0.5) == 1


def test_decisions(spark):
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    rows = [(0, 1, 10, 0.95, "a"), (1, 1, 10, 0.5, "a"), (2, 1, 10, 0.39, "a"), (3, 1, 10, 0.7, "a"), (3, 2, 11, 0.69, "b")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, pos long, score double, name string")
    got = {r.query_id: (r.confidence, r.candidates) for r in vectors.identify(q, hits).collect()}
    assert got == {0: ("CONFIDENT", [10]), 1: ("AMBIGUOUS", [10]), 2: ("NO_MATCH", [10]), 3: ("CONFIDENT", [10, 11]), 4: ("NO_MATCH", [])}
    decided = {r.query_id: (r.confidence, r.name, round(r.gap, 2)) for r in vectors.decide_match(q, hits).collect()}
    assert decided == {0: ("CONFIDENT", "a", 1.0), 1: ("AMBIGUOUS", "a", 1.0), 2: ("NO_MATCH", None, 1.0), 3: ("AMBIGUOUS", "a", 0.01), 4: ("NO_MATCH", None, 0.0)}


def test_numbered(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert all(r.k == r.pos for r in vectors.numbered(rows, "k").collect())


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = row.select(V.norm("a"), V.cosine("a", "b"), V.l2_normalize(F.col("a")), V.l2_normalize(F.col("b")), V.pixel_normalize(F.array(F.lit(255.0)))).first()
    assert tuple(got) == (5.0, None, [0.6, 0.8], [0.0, 0.0], [1.0])


def test_fold(spark):
    rows = lib(spark, card("a", count=1, year=2010, ord=2), card("b", count=2, year=2025, ord=1, photo="p"), card("c", count=1, year=2020), card("n", None), card("m", None), card("f", foil=True))
    got = {r.card_id: (r.count_, r.created_at, r.photo) for r in library.fold_duplicates(rows).withColumnRenamed("count", "count_").collect()}
    assert got["a"] == (4, at(2025), "p") and set(got) == {"a", "n", "m", "f"}
    assert library.check_printing_rule(library.fold_duplicates(rows)).count() == 0 and library.check_printing_rule(rows).count() == 1


def test_upserts(spark):
    held = lib(spark, card("a", count=3, year=2020), card("p", None))
    new = lib(spark, card("b", count=5, year=2022, ord=9), card("c", "y", ord=8, count=2), card("q", None, ord=7))
    added = {r.card_id: (r["count"], r.created_at, r.merged) for r in library.upsert_add(held, new).collect()}
    assert added == {"a": (8, at(2022), True), "c": (2, at(2020), False), "p": (1, at(2020), False), "q": (1, at(2020), False)}
    one = library.upsert_set(held, lib(spark, card("b", count=2, year=2022)))
    assert {(r.card_id, r["count"], r.created_at) for r in one.collect()} == {("a", 2, at(2020)), ("p", 1, at(2020))}
    same = library.upsert_set(held, held.filter("scryfall_id is not null"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, held.collect()))


def test_insert_update_delete_merge(spark):
    held = lib(spark, card("a", count=3, year=2020), card("b", "y", count=5, year=2024, photo="p"), card("c", "z"))
    bad = library.insert_conflicts(held, lib(spark, card("a", "new"), card("d", "y"), card("e", "w", count=0), card("f", "v")))
    assert {(r.card_id, r.error) for r in bad.collect()} == {("a", "card_id is held"), ("d", "printing is held"), ("e", "count below one")}
    pairs = spark.createDataFrame([("b", "a"), ("c", "c"), ("no", "a")], "source string, target string")
    assert {r.error for r in library.merge_errors(held, pairs).collect()} == {"self", "no source"}
    merged = {r.card_id: (r["count"], r.created_at, r.photo) for r in library.merge_cards(held, pairs).collect()}
    assert merged == {"a": (8, at(2024), "p"), "c": (1, at(2020), None)}
    ids = spark.createDataFrame([("a",), ("zz",)], "card_id string")
    assert library.delete_cards(held, ids).count() == 2 and {(r.card_id, r.existed) for r in library.deleted(held, ids).collect()} == {("a", True), ("zz", False)}


def test_insert_is_one_by_one(spark):
    held = lib(spark, card("a", "x"))
    rows = [("b", "y"), ("c", "y"), ("b", "z"), ("c", "w"), ("d", "w"), ("e", None), ("f", None), ("d", "v")]
    cards = lib(spark, *[card(i, k, ord=n) for n, (i, k) in enumerate(rows)])
    order = {(r.card_id, r.scryfall_id): r.ord for r in cards.collect()}
    taken, want = {("a",), ("x", False)}, {("a", "x")}
    for i, k in sorted(rows, key=lambda r: order[r]):
        keys = {(i,)} | ({(k, False)} if k else set())
        if not keys & taken:
            taken |= keys
            want.add((i, k))
    out = library.insert_cards(held, cards)
    assert {(r.card_id, r.scryfall_id) for r in out.collect()} == want and library.check_printing_rule(out).count() == 0
    assert library.insert_conflicts(held, cards).count() == len(rows) + 1 - len(want)


def test_categories(spark):
    schema = "filename string, name string, set_code string, collector_number string, frame string, border_color string, full_art boolean, layout string, frame_effects array<string>, rarity string, face_index int"
    rows = [
        ("plain", "2015", "black", False, "normal", [], "rare", 0), ("legend", "2015", "black", False, "normal", ["legendary"], "common", 0), ("show", "2015", "borderless", False, "normal", ["showcase"], "bonus", 0),
        ("gold", "1997", "gold", False, "normal", None, "rare", 0), ("full", "2015", "black", True, "normal", [], "mythic", 0), ("back", "2003", "white", False, "transform", [], "rare", 1), ("nyx", "future", "silver", True, "prepare", ["enchantment"], "rare", 2),
    ]
    faces = spark.createDataFrame([(n, n, "s", "1", f, b, a, y, e, r, i) for n, f, b, a, y, e, r, i in rows], schema)
    of: dict[str, set] = {}
    for r in sampling.test_categories(faces).collect():
        of.setdefault(r.name, set()).add(r.category)
    assert of == {
        "plain": {"2015_black", "rarity_rare"}, "legend": {"2015_black", "effect_legendary", "rarity_common"}, "show": {"treatment_showcase"}, "gold": {"border_gold"},
        "full": {"treatment_fullart_black", "rarity_mythic"}, "back": {"layout_transform", "back_face"}, "nyx": {"effect_nyxtouched", "layout_prepare"},
    }
    pools = {(r.name, r.pool) for r in sampling.crop_pools(faces).collect()}
    assert pools == {("plain", "2015_black"), ("legend", "2015_black"), ("show", "showcase"), ("back", "white_border")}


def test_fuzzy_ratio_is_a_plain_ratio(spark):
    from difflib import SequenceMatcher

    r = random.Random(4)
    pairs = [("".join(r.choices("abcd ", k=r.randint(0, 14))), "".join(r.choices("abcd ", k=r.randint(0, 14)))) for _ in range(300)]
    rows = spark.createDataFrame(pairs + [(None, "a")], "a string, b string").withColumns({"whole": X.fuzzy_ratio("a", "b"), "limited": X.fuzzy_ratio("a", "b", F.lit(0.6))})
    for row in rows.collect():
        want = None if row.a is None else SequenceMatcher(None, row.a, row.b).ratio()
        assert row.whole == want and (row.limited == want or want < 0.6 and row.limited == 0)


def test_stream_forgets_ids(spark, tmp_path):
    """With a bound on lateness the stream's result is the batch's, and repeated ids in time count once."""
    from cardloom.streaming.scans import stream_scans

    rows = [(f"c{i}", f"k{i % 3}", False, 1, at(2020 + i % 2), i) for i in range(20)]
    frame = spark.createDataFrame(rows + rows[:5], "card_id string, scryfall_id string, foil boolean, count long, created_at timestamp, ord long")
    frame.write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    stream = stream_scans(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), lambda batch, n: batch.write.mode("append").parquet(out), f"{tmp_path}/check", "3000 days")
    stream.awaitTermination()
    got = {r.scryfall_id: r.n for r in spark.read.parquet(out).groupBy("scryfall_id").agg(F.max("count").alias("n")).collect()}
    assert got == {"k0": 7, "k1": 7, "k2": 6}


def test_change_lands_on_another(spark):
    held = lib(spark, card("a", "x", count=3), card("b", "y", count=4, ord=1))
    patch = [("b", at(2030), True, False, False, False, False, True, "x", None, None, None, None, 9)]
    fields = [p for p in library.PATCH if p != "created_at"]
    names = ["card_id string", "now timestamp"] + [f"set_{p} boolean" for p in fields] + [f"{p} {'boolean' if p == 'foil' else 'long' if p == 'count' else 'string'}" for p in fields]
    got = library.change_cards(held, spark.createDataFrame(patch, ", ".join(names))).collect()
    assert [(r.card_id, r["count"]) for r in got] == [("a", 12)]


def test_validate_updates(spark):
    bodies = ['{"name": "  "}', '{"count": 2.5}', '{"count": 3, "scryfall_id": ""}', "[]", '{"foil": 1}', "{}", None]
    rows = library.validate_updates(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert [r.error for r in rows] == ["name is blank", "count is not from 1 to 9999", None, "not an object", "foil is not a boolean", None, "not an object"]
    assert rows[2].set_scryfall_id and rows[2].scryfall_id is None and rows[2]["count"] == 3


CAT = "pos long, scryfall_id string, name string, set_code string, collector_number string, lang string"


def test_import(spark):
    cat = spark.createDataFrame([(0, "ja", "Bolt", "m11", "146", "ja"), (1, "en", "Bolt", "M11", "146", "en"), (2, "el", "Elf", "m11", "2", None)], CAT)
    rows = [(1, 1, "Bolt", "m11", "146", False, "en", at(2020)), (2, 2, "Bolt", "m11", "146", False, "en", at(2021)), (3, 1, "Nope", "zzz", "1", False, "en", None), (4, 4, "Bolt", "m11", "146", False, "ja", None)]
    lines = spark.createDataFrame(rows, "line long, count long, name string, set_code string, collector_number string, foil boolean, lang string, modified_at timestamp")
    empty = lib(spark, card("z")).limit(0)
    once = imports.import_collection(empty, lines, cat)
    assert {(r.scryfall_id, r["count"]) for r in once.collect()} == {("en", 3), ("ja", 4), (None, 1)}
    twice = imports.import_collection(once, lines, cat)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    more = imports.import_collection(once, lines, cat, "add")
    assert {(r.scryfall_id, r["count"]) for r in more.collect()} == {("en", 6), ("ja", 8), (None, 2)}
    report = imports.import_report(once, lines, cat).first()
    assert (report.rows, report.unmatched, report.added, report.updated, report.unmatched_names) == (4, 1, 0, 3, ["Nope"])


def test_csv(spark, tmp_path):
    text = '﻿Count,Name,Edition,Collector Number,Foil,Language,Last Modified\r\n"2","Lightning ""Bolt""","M11","146","foil","Japanese","2024-01-02 03:04:05.678901"\r\n\r\n,"A, B\nC",x,1,,Elvish,yesterday\r\n0,Bad,x,1,,,\r\n2.0,Ok,x,1,,,\r\n1, ,x,1,,,\r\n'
    (tmp_path / "in.csv").write_text(text, encoding="utf-8", newline="")
    rows = csv.scan_moxfield_csv(spark, f"file://{tmp_path}/in.csv").orderBy("line").collect()
    assert [(r["count"], r.name, r.set_code, r.foil, r.lang, r.error) for r in rows] == [
        (2, 'Lightning "Bolt"', "m11", True, "ja", None), (1, "A, B\nC", "x", False, "en", None), (None, "Bad", "x", False, "en", "bad count: 0"), (2, "Ok", "x", False, "en", None), (1, "", "x", False, "en", "no name"),
    ]
    assert rows[0].modified_at == datetime(2024, 1, 2, 3, 4, 5, 678000) and rows[1].modified_at is None
    with pytest.raises(Exception, match="bad count"):
        csv.scan_moxfield_csv(spark, f"file://{tmp_path}/in.csv", strict=True).collect()
    out = f"file://{tmp_path}/out"
    csv.export_moxfield_csv(lib(spark, card("a", name='Say "x", y', foil=True), card("b", None, name="Unknown")), out)
    back = csv.scan_moxfield_csv(spark, out).collect()
    assert [(r.name, r["count"], r.foil) for r in back] == [('Say "x", y', 1, True)]
    lines = [x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines() if not x.startswith('"Count"')]
    assert lines == ['"1","1","Say ""x"", y","m11","Near Mint","English","foil","","2020-01-01 00:00:00.000000","1","False","False",""']


def test_faces(spark, tmp_path):
    lines = [
        '{"id":"1","name":"One","set":"a","collector_number":"213★","image_uris":{"normal":"u"},"colors":["G","W","G"],"cmc":2}', "",
        '{"id":"2","name":"Two // Faces","set":"a","collector_number":"2","artist":"X","card_faces":[{"name":"Two","image_uris":{"normal":"u"},"colors":["U"]},{"name":"Faces","artist":"Y","image_uris":{"normal":"v"}}]}',
        '{"id":"3","name":"None","set":"a","collector_number":"3","card_faces":[{"name":"q"}]}', '{"id":"4","name":"Large only","set":"a","collector_number":"4","image_uris":{"large":"w"},"card_faces":[{"name":"q","image_uris":{"normal":"z"}}]}',
    ]
    (tmp_path / "bulk-1.jsonl").write_text("\n".join(lines), encoding="utf-8")
    faces = catalog.explode_card_faces(bulk.scan_bulk_cards(spark, f"file://{tmp_path}/bulk-1.jsonl"))
    got = sorted((r.scryfall_id, r.face_index, r.name, r.artist, r.colors, r.filename, r.lang) for r in faces.collect())
    assert got == [("1", 0, "One", "", "WG", "a-213_.jpg", "en"), ("2", 0, "Two", "X", "U", "a-2.jpg", "en"), ("2", 1, "Faces", "Y", "", "a-2_face1.jpg", "en")]
    (tmp_path / "bulk-2.json").write_text("[" + lines[0] + "]", encoding="utf-8")
    assert bulk.scan_bulk_cards(spark, f"file://{tmp_path}/bulk-2.json", legacy=True).count() == 1
    assert bulk.latest_path(spark, f"file://{tmp_path}", "bulk*").endswith("bulk-2.json")
    with pytest.raises(FileNotFoundError):
        bulk.scan_latest_bulk(spark, f"file://{tmp_path}", "*.nothing")


def test_refresh(spark):
    old = spark.createDataFrame([(0, "f", "old", "k"), (1, "g", None, "l")], "pos long, filename string, name string, extra string")
    both = spark.createDataFrame([(0, "f", None), (1, "g", "new"), (2, "g", "second")], "pos long, filename string, name string")
    fresh = catalog.refresh_metadata(old, both)
    assert fresh.columns == ["pos", "filename", "name"] and {(r.pos, r.name) for r in fresh.collect()} == {(0, None), (1, "new")}
    stale = catalog.refresh_metadata(old, both.filter("filename = 'g'"))
    assert {(r.pos, r.name, r.extra) for r in stale.collect()} == {(0, "old", "k"), (1, "new", "l")}


def test_search(spark):
    rows = [
        (1, "Lightning Bolt", "m11", "146", None), (2, "Bolt", "neo", "17", "en"), (3, "Firebolt", "neo", "172", "ja"), (4, "Bolt Bend", "neo", "1720", "en"), (5, "Elf", "m11", "9", "en"),
        (6, "Elf", "m11", "10", "en"), (7, "Firebolt", "NEO", "172", "en"), (8, "Bo", "x1", "9" * 30, "en"), (9, "Bo", "x1", "1" + "0" * 30, "en"),
    ]
    cat = spark.createDataFrame([(p, f"s{p}", n, s, c, x) for p, n, s, c, x in rows], "pos long, scryfall_id string, name string, set_code string, collector_number string, lang string")
    q = spark.createDataFrame([(0, " BOLT "), (1, "neo 172"), (2, "m11 999"), (3, "b"), (4, "elf"), (5, "bo"), (6, "zz"), (7, "ng bo")], "query_id long, query string")
    got: dict[int, list[int]] = {}
    for r in search.name_search(q, cat).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.pos)
    assert got == {0: [2, 4, 1, 3, 7], 1: [7, 3], 4: [5, 6], 5: [8, 9, 2, 4, 1, 3, 7], 7: [1]}


def test_views(spark):
    schema = "card_id string, scryfall_id string, name string, set_code string, collector_number string, foil boolean, count long, created_at timestamp, ord long, artist string, type_line string, rarity string, set_name string, colors string, mana_value double, released_at string"
    rows = [
        ("b", "1", "Lightning Bolt", "m11", "146", False, 1, at(2020), 0, "Rush", "Instant", "common", "Magic 2011", "R", 1.0, "2010"), ("k", "2", "Kor Outfitter", "zen", "21", True, 3, at(2021), 1, "Z", "Creature", "rare", "Zendikar", "W", 2.0, "2009"),
        ("g", "3", "Gold Card", "m11", "7", False, 1, at(2019), 2, None, "Artifact Creature", "mythic", "Magic 2011", "WU", 7.0, None), ("f", "4", "Forest", "zen", "9", False, 1, at(2022), 3, "Z", "Basic Land", "common", "Zendikar", "", 0.0, "2009"), ("u", None, "Unknown", None, None, False, 1, at(2018), 4, None, None, None, None, None, None, None),
    ]
    cards = spark.createDataFrame(rows, schema)
    ids = lambda **v: [r.card_id for r in views.apply_view(cards, views.View(**v)).orderBy("place").collect()]
    assert ids() == ["f", "k", "b", "g", "u"] and ids(sort="name") == ["f", "g", "k", "b", "u"] and ids(sort="rarity") == ["g", "k", "f", "b", "u"]
    assert ids(sort="mana") == ["f", "b", "k", "g", "u"] and ids(sort="release")[-2:] == ["g", "u"] and ids(sort="set")[0] == "u"
    assert ids(colors=("C",)) == ["f"] and ids(colors=("M", "R")) == ["b", "g"] and ids(mana=("6+", "0")) == ["f", "g"] and ids(types=("creature",)) == ["k", "g"]
    assert ids(foil="foil") == ["k"] and ids(attention=True) == ["u"] and ids(multiples=True) == ["k"] and ids(query="m11 14") == ["b"] and ids(query="zend") == ["f", "k"]
    assert {(r.value, r.label, r.n) for r in views.facet_sets(cards).collect()} == {("m11", "Magic 2011", 2), ("zen", "Zendikar", 2)}
    url = spark.createDataFrame([("http://x/?set=a,,b&color=W&foil=odd&sort=bad&q=a%2Bb+c&copies=multi",)], "url string")
    v = views.parse_view_urls(url).select("view.*", views.serialize_view().alias("s"), views.active_filter_count().alias("n")).first()
    assert (v.sets, v.colors, v.foil, v.sort, v.query, v.multiples, v.n) == (["a", "b"], ["W"], "any", "date", "a+b c", True, 3)
    assert v.s == "set=a%2Cb&color=W&copies=multi&q=a%2Bb+c"
    assert [(r.facet, r.value) for r in views.active_chips(views.parse_view_urls(url)).orderBy("place").collect()] == [("sets", "a"), ("sets", "b"), ("colors", "W"), ("multiples", "2+")]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(X.parse_timestamp(F.lit("yesterday"))) is None and value(X.parse_timestamp(F.lit("2024-02-03T04:05:06"))) == datetime(2024, 2, 3, 4, 5, 6)
    assert value(X.format_timestamp(F.lit(None).cast("timestamp"))) == "" and value(X.csv_field(F.lit('a"b'))) == '"a""b"' and value(X.csv_field(F.lit("a b"))) == "a b"
    assert [value(X.mana_bucket(F.lit(v))) for v in (5.9, 6.0, 16.0)] == ["5", "6+", "6+"] and value(X.sanitize(F.lit("Ä b/c: d"), 4)) == "Ä_bc"
    assert value(X.parse_corners(F.lit("1,2;3,x"))) is None and value(X.parse_corners(F.lit(" "))) is None and len(value(X.parse_corners(F.lit("1,2;3,4")))) == 2
    assert [value(X.valid_card_id(F.lit(v))) for v in ("a-b_1", "-a", "a" * 65, "a\n")] == [True, False, False, False]
    assert value(X.fuzzy_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75 and value(X.normalize_name(F.lit(" Æther, Vial! "))) == "ther vial"


def test_latest_bulk_reads_all_files_of_a_folder(spark, tmp_path):
    ids = lambda n: spark.range(n).selectExpr("cast(id as string) AS id")
    ids(5).write.json(f"file://{tmp_path}/d/bulk-1")
    ids(8).repartition(3).write.json(f"file://{tmp_path}/d/bulk-2")
    assert sorted(r.id for r in bulk.scan_latest_bulk(spark, f"file://{tmp_path}/d").collect()) == [str(i) for i in range(8)]
    (tmp_path / "flat").mkdir()
    for n in (1, 2):
        (tmp_path / "flat" / f"bulk-{n}.json").write_text(f'{{"id": "{n}"}}')
    assert [r.id for r in bulk.scan_latest_bulk(spark, f"{tmp_path}/flat").collect()] == ["2"]


def test_detections(spark):
    flat = [10.0, 10, 8, 4, 0.9, 0, 0.0, 11.0, 10, 8, 4, 0.8, 0, 0.0, 50.0, 50, 4, 8, 0.5, 0, 0.1, 5.0, 5, 9, 9, float("nan"), 0, 0]
    raw = spark.createDataFrame([(1, [1, 4, 7], [float(x) for x in flat])], "image_id long, dims array<int>, data array<float>")
    got = detections.detect_postprocess(raw, 60.0).orderBy("det_id").collect()
    assert [r.det_id for r in got] == [0, 2] and got[0].w == 4 and got[0].h == 8 and got[0].angle == pytest.approx(np.pi / 2)
    other = spark.createDataFrame([(1, [1, 6, 2], [float(x) for x in range(12)])], "image_id long, dims array<int>, data array<float>")
    assert [(r.cx, r.conf, r.angle) for r in detections.decode_detections(other).orderBy("det_id").collect()] == [(0, 8, 10), (1, 9, 11)]
    with pytest.raises(Exception, match="unknown layout"):
        detections.decode_detections(spark.createDataFrame([(1, [1, 2, 3], [0.0])], "image_id long, dims array<int>, data array<float>")).collect()
    line = spark.createDataFrame([("3 0.1 0.1 0.3 0.1 0.3 0.4 0.1 0.4",)], "value string")
    assert detections.obb_to_keypoint(line).first().keypoints == "3 0.200000 0.250000 0.200000 0.300000 0.100000 0.100000 2 0.300000 0.100000 2 0.300000 0.400000 2 0.100000 0.400000 2"
    with pytest.raises(Exception, match="nine fields"):
        detections.obb_to_keypoint(spark.createDataFrame([("1 2",)], "value string")).collect()


def test_detections_in_image_pixels(spark):
    """Images of 200 x 100 and 50 x 100, fitted into a square of 100; a box across an edge is clamped to its own image."""
    one, edge = [50.0, 50.0, 10.0, 20.0, 0.9, 0.0, 0.0], [95.0, 50.0, 20.0, 30.0, 0.8, 0.0, 0.0]
    schema = "image_id long, dims array<int>, data array<float>, scale double, pad_x int, pad_y int, width int, height int"
    raw = spark.createDataFrame([(1, [1, 2, 7], one + edge, 0.5, 0, 25, 200, 100), (2, [1, 1, 7], one, 1.0, 25, 0, 50, 100)], schema)
    rows = {(r.image_id, r.det_id): r for r in detections.detect_postprocess(raw, 100.0).collect()}
    got = {k: (r.cx, r.cy, r.w, r.h, [tuple(p) for p in r.corners]) for k, r in rows.items()}
    assert got == {
        (1, 0): (100, 50, 20, 40, [(90, 30), (110, 30), (110, 70), (90, 70)]),
        (1, 1): (190, 50, 40, 60, [(170, 20), (200, 20), (200, 80), (170, 80)]),
        (2, 0): (25, 50, 10, 20, [(20, 40), (30, 40), (30, 60), (20, 60)]),
    }
    with pytest.raises(ValueError, match="only"):
        detections.detect_postprocess(raw.drop("scale"), 100.0)


def test_flat_vectors(spark, tmp_path):
    index = spark.createDataFrame([(i, [float(i), i / 2]) for i in range(10)], "pos long, embedding array<float>")
    path = f"file://{tmp_path}/v.bin"
    files.write_flat_vectors(index, path, 2)
    assert sorted(map(tuple, files.scan_flat_vector_file(spark, path).collect())) == sorted(map(tuple, index.collect()))
    files.join_flat_vectors(path, path + ".one")
    assert sorted(map(tuple, files.scan_flat_vector_file(spark, path + ".one").collect())) == sorted(map(tuple, index.collect()))
    raw = (tmp_path / "v.bin.one").read_bytes()
    assert raw[:4] == b"IxFI" and struct.unpack_from("<i", raw, 4)[0] == 2 and struct.unpack_from("<q", raw, 8)[0] == 10 and struct.unpack_from("<q", raw, 37)[0] == 20
    for broken in (raw[:20], b"IxXX" + raw[4:], raw[:-4], raw[:33] + b"\x01" + raw[34:]):
        with pytest.raises(ValueError):
            files.flat_header(broken[:45], len(broken))


def test_ground_truth(spark, tmp_path):
    (tmp_path / "gt.json").write_text('{"a/1.jpg": "Bolt", "b.jpg": {"card_name": "Elf", "set_code": "m11", "collector_number": "9"}}')
    rows = {r.path: (r.name, r.set_code, r.collector_number) for r in files.scan_ground_truth_json(spark, f"file://{tmp_path}/gt.json").collect()}
    assert rows == {"a/1.jpg": ("Bolt", None, None), "b.jpg": ("Elf", "m11", "9")}


def test_sampling(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).cast("string").alias("set_code"))
    taken = sampling.sample_set_diverse(rows, 40, "k")
    assert taken.count() == 40 and taken.select("set_code").distinct().count() == 10
    assert sorted(r.k for r in taken.collect()) == sorted(r.k for r in sampling.sample_set_diverse(rows.repartition(9), 40, "k").collect())
    assert sampling.sample_set_diverse(rows.limit(7), 40, "k").count() == 7


def test_profile(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "p string, q string")
    assert {(r.dimension, r.value, r.n, r.pct) for r in profile.value_counts(rows, "p", "q").collect()} == {("p", "a", 2, 66.6667), ("p", "b", 1, 33.3333), ("q", "x", 1, 33.3333), ("q", "y", 1, 33.3333)}
    cross = {(r.p, r.q): r.n for r in profile.crosstab_margins(rows, "p", "q").collect()}
    assert cross == {("a", "x"): 1, ("a", "y"): 1, ("a", "All"): 2, ("All", "x"): 1, ("All", "y"): 1, ("All", "All"): 2}


def test_folding_a_stream_equals_a_batch(spark):
    rows = spark.createDataFrame([(str(i % 40), str(i % 5), i % 2 == 0, 1, at(2000 + i % 9), i) for i in range(80)], "card_id string, scryfall_id string, foil boolean, count long, created_at timestamp, ord long")
    got = fold_scans(rows).collect()
    assert sum(r["count"] for r in got) == 40 and len(got) == 10


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    assert entry.entry(spark).count() > 0
