"""Steps whose work grows no faster than their input, or than their result."""

from __future__ import annotations

import hashlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from cardloom.operators import catalog, detections, library, sampling, search, vectors
from cardloom.plans import tables
from cardloom.streaming import scans


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def used(df) -> int:
    """Partitions of the result that hold rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_printings_are_ranked_before_they_meet(spark):
    """One set and number that all rows want: the pairs are dealt out, and nothing is done to them behind the join."""
    items = spark.createDataFrame([(k, "S", "1a", str(k % 20), "n", None if k % 2 else "ja") for k in range(40)], "pos long, set_code string, collector_number string, scryfall_id string, name string, lang string")
    wanted = spark.createDataFrame([(k, "s", "1A") for k in range(300)], "row long, set_code string, collector_number string")
    found = catalog.find_printings(wanted.unionByName(wanted), items)
    place = {x: k + 1 for k, x in enumerate([*range(1, 20, 2), *range(0, 20, 2)])}
    want = {(r, str(x), place[x]) for r in range(300) for x in range(20)}
    got = [(r.row, r.scryfall_id, r.place) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert used(found) > 1
    above = plan_of(found).split("Join Inner")[0]
    assert "Window" not in above and "Aggregate" not in above


def test_queries_of_one_text_are_looked_for_once(spark, tmp_path, monkeypatch):
    rows = [(p, f"s{p}", n, "neo", str(p), None) for p, n in enumerate(["Bolt", "Firebolt", "Bolt Bend", "Elf"])]
    index = search.build_name_index(spark.createDataFrame(rows, "pos long, scryfall_id string, name string, set_code string, collector_number string, lang string"), f"file://{tmp_path}/index")
    queries = spark.createDataFrame([(k, ["bolt", " BOLT", "neo 3", "zz"][k % 4]) for k in range(400)], "query_id long, query string")
    looked_for = []
    whole = search._found
    monkeypatch.setattr(search, "_found", lambda texts, held: looked_for.append(texts) or whole(texts, held))
    got = {}
    for r in search.search_names(queries, index).collect():
        got.setdefault(r.query_id, []).append((r.place, r.pos))
    want = [[(1, 0), (2, 2), (3, 1)]] * 2 + [[(1, 3)]]
    assert {k: sorted(v) for k, v in got.items()} == {k: want[k % 4] for k in range(400) if k % 4 < 3}
    assert {r.query_id: r.n for r in search.count_found(queries, index).collect()} == {k: len(v) for k, v in got.items()}
    assert [t.count() for t in looked_for] == [3, 3]


def test_every_score_is_not_ranked(spark):
    index = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(50)], "pos long, embedding array<float>")
    queries = index.filter("pos % 10 = 0").select(F.col("pos").alias("query_id"), "embedding")
    found = vectors.every_score(queries, index)
    assert "Window" not in plan_of(found)
    got = sorted((r.query_id, r.pos, r.score) for r in found.collect())
    assert got == sorted((q, p, (q % 7) * (p % 7) + 1.0) for q in range(0, 50, 10) for p in range(50))


def test_inserts_make_their_library_once(spark):
    """What the library and the cards are made of is read for each of them once; the result reads tables that are kept."""
    made = spark.range(20).filter("id >= 0")
    rows = made.select(F.col("id").cast("string").alias("card_id"), F.concat(F.lit("p"), F.col("id") % 15).alias("scryfall_id"), *[F.lit("x").alias(c) for c in ("name", "set_code", "collector_number")], F.lit(False).alias("foil"), F.lit(1).cast("long").alias("count"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"), F.col("id").alias("ord"), F.lit("y").alias("photo"))
    out = library.insert_cards(rows.filter("ord < 5"), rows.filter("ord >= 5"))
    assert "Range (" not in plan_of(out)
    assert sorted(int(r.card_id) for r in out.collect()) == list(range(15))


def test_label_lines_are_turned_by_the_batch(spark):
    """Numbers are what the formatter writes, halves between two of six decimals too, and no column formats one by one."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    k = F.col("id")
    point = lambda a, b: F.struct((k * a % 1001 - 100).cast("double").alias("x"), (k * b % 997 - 50).cast("double").alias("y"))
    rows = spark.range(3000).withColumn("corners", F.array(point(7, 3), point(11, 5), point(13, 17), point(19, 23)))
    rows = rows.withColumn("value", detections.corners_to_obb(F.col("corners"), F.lit(640), F.lit(777))).withColumn("value", F.when(k % 5 == 0, F.concat(F.lit(" \t"), F.replace("value", F.lit(" "), F.lit("  ")))).otherwise(F.col("value")))
    out = detections.obb_to_keypoint(rows)
    assert "format_string" not in plan(out)
    for r in out.collect():
        c = [(min(max(p.x / 640, 0.0), 1.0), min(max(p.y / 777, 0.0), 1.0)) for p in r.corners]
        assert [abs(float(t) - v) <= 5.000001e-7 for t, v in zip(r.value.split()[1:], [v for p in c for v in p], strict=True)] == [True] * 8
        c = [tuple(map(Decimal, r.value.split()[i : i + 2])) for i in (1, 3, 5, 7)]
        six = lambda v: f"{v.quantize(Decimal('0.000001'), ROUND_HALF_UP):f}"
        x, y = zip(*c, strict=True)
        box = [(min(x) + max(x)) / 2, (min(y) + max(y)) / 2, max(x) - min(x), max(y) - min(y)]
        f = [(float(a), float(b)) for a, b in c]
        order = [min(range(4), key=lambda i: key(*f[i])) for key in (lambda a, b: a + b, lambda a, b: b - a, lambda a, b: -(a + b), lambda a, b: a - b)]
        got = r.keypoints.split(" ")
        assert got[0] == "0" and got[5:] == [t for i in order for t in (six(c[i][0]), six(c[i][1]), "2")]
        assert all(abs(Decimal(g) - v) <= Decimal("0.0000006") for g, v in zip(got[1:5], box, strict=True))
    shares = np.array([0.0, 1.0, 0.0000005, 0.0000015, 0.9999995, 0.9999994, 0.1234565, 0.12345649999, 1e-9, 0.3 + 0.0000005])
    want = [r.t for r in spark.createDataFrame([(float(v),) for v in shares], "v double").select(F.format_string("%.6f", "v").alias("t")).collect()]
    assert detections._six_texts(shares).to_pylist() == want


def test_small_images_are_judged_together(spark, monkeypatch):
    """Many images of few boxes, and one of many: the same boxes stay as one by one, and only the large image goes alone."""
    r = np.random.default_rng(3)
    n = [*r.integers(1, detections.FEW + 1, 300), detections.FEW + 1]
    rows = [(i, d, *map(float, r.uniform(0, 60, 2)), *map(float, r.uniform(5, 30, 2)), float(r.choice([0.0, 0.7])), float(r.integers(0, 9)) / 10) for i, k in enumerate(n) for d in range(k)]
    boxes = []
    for k in np.cumsum([0, *n[:-1]]):
        own = sorted(rows[k : k + n[len(boxes)]], key=lambda x: (-x[7], x[1]))
        c, s = (np.abs(f([x[6] for x in own])) for f in (np.cos, np.sin))
        x, y, w, h = np.array([x[2:6] for x in own]).T
        hw, hh = (w * c + h * s) / 2, (w * s + h * c) / 2
        boxes.append((own, np.stack([x - hw, y - hh, x + hw, y + hh], axis=1)))
    dets = spark.createDataFrame(rows, "image_id long, det_id long, cx double, cy double, w double, h double, angle double, conf double")
    for most in (None, 3):
        want = {own[i][:2] for own, b in boxes for i in detections._greedy(b, 0.3, most)}
        got = [(x.image_id, x.det_id) for x in detections.nms(dets, 0.3, most).collect()]
        assert len(got) == len(want) and set(got) == want
    alone = []
    monkeypatch.setattr(detections, "_greedy", lambda b, *_: alone.append(len(b)) or [0])
    flags = detections._greedy_together(np.concatenate([b for _, b in boxes[:-1]]), np.cumsum([0, *n[:-2]]), np.array(n[:-1]), 0.3, None)
    assert flags.sum() and not alone


def test_boxes_of_small_images_meet_without_a_grid(spark, monkeypatch):
    """A small image's pairs are found by image, a large one's on the grid, and both equal the nested loop."""
    r = np.random.default_rng(5)
    rows = [(i, d, *map(float, r.integers(0, 40, 2)), *map(float, r.integers(1, 20, 2)), 0.0, 0.5) for i, k in enumerate((1, 2, 7, detections.FEW, detections.FEW + 1, 60)) for d in range(k)]
    rows.append((7, 1, float("nan"), 0.0, 1.0, 1.0, 0.0, 0.5))
    dets = spark.createDataFrame(rows, "image_id long, det_id long, cx double, cy double, w double, h double, angle double, conf double")
    want = {}
    for p in rows:
        for q in rows:
            wide, high = (min(p[c] + p[s] / 2, q[c] + q[s] / 2) - max(p[c] - p[s] / 2, q[c] - q[s] / 2) for c, s in ((2, 4), (3, 5)))
            if p[0] == q[0] and p[1] < q[1] and wide > 0 and high > 0:
                want[p[0], p[1], q[1]] = wide * high / (p[4] * p[5] + q[4] * q[5] - wide * high)
    got = {(x.image_id, x.a, x.b): x.iou for x in detections.pairwise_iou(dets).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    handed, grid = [], detections._iou_by_grid
    monkeypatch.setattr(detections, "_iou_by_grid", lambda box: handed.append(box) or grid(box))
    detections.pairwise_iou(dets)
    assert {x.image_id for x in handed[0].select("image_id").distinct().collect()} == {4, 5}


def test_lines_are_dealt_by_part_once(spark):
    """The first line of a key is taken where it lies, after one shuffle by part and without an aggregation before it."""
    plan = tables.library_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == plan.count("Exchange") == 1 and "Aggregate" not in plan


def sorted_rows(df) -> list[int]:
    """Rows that reach each sort of a plan that has run."""
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        nodes += children
        if node.nodeName() == "Sort":
            below = children[0]
            while below.metrics().get("numOutputRows").isEmpty():
                below = below.children().apply(0)
            found.append(below.metrics().apply("numOutputRows").value())
    return found


def test_a_sample_sorts_few_rows(spark, tmp_path):
    """Of sets with very many rows only some beyond the wanted ones are sorted, and the sample is that of all rows: sets that
    are null, keys that repeat and pools that are taken whole among them."""
    rows = [(k, f"f{k}", None if k % 7 == 6 else f"s{k % 7}", "large") for k in range(7000)] + [(k, "same", "s0", "copies") for k in range(300)] + [(k, f"g{k}", "s1", "small") for k in range(9)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.createDataFrame(rows, "pos long, filename string, set_code string, category string").write.parquet(f"{tmp_path}/rows")
        found = sampling.sample_set_diverse(spark.read.parquet(f"{tmp_path}/rows"), 20, "filename", within="category")
        got = found.collect()
        assert 0 < max(sorted_rows(found)) < 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    md5 = lambda x, seed: hashlib.md5(f"{x}|{seed}".encode()).hexdigest()
    large, ranked = [r for r in rows if r[3] == "large"], []
    for code in {r[2] for r in large}:
        order = sorted((r for r in large if r[2] == code), key=lambda r: md5(r[1], 0))
        # md5 of a null set is that of the seed alone.
        first = hashlib.md5(b"1").hexdigest() if code is None else md5(code, 1)
        ranked += [((0, first, k) if k < 20 // (2 * 7) else (1, md5(r[1], 0), 0), r) for k, r in enumerate(order)]
    assert {r.pos for r in got if r.category == "large"} == {r[0] for _, r in sorted(ranked)[:20]}
    assert len([r for r in got if r.category == "copies"]) == 20 and {r.pos for r in got if r.category == "small"} == set(range(9))


def test_orders_are_numbered_after_one_shuffle(spark, monkeypatch):
    """Rows of an order are shuffled once, and only what is asked for is kept."""
    handed, kept = [], vectors.kept
    monkeypatch.setattr(vectors, "kept", lambda df, name: handed.append(df) or kept(df, name))
    rows = spark.range(500).select(F.col("id").alias("card"), (F.col("id") % 9).alias("of"), F.lit("x").alias("more"))
    got = vectors.places(rows, F.desc("of"), "card", columns=("card",))
    want = sorted(range(500), key=lambda k: (-(k % 9), k))
    assert {(r.card, r.place) for r in got.collect()} == {(k, i + 1) for i, k in enumerate(want)}
    assert handed[0].columns == ["card", "_part", "_n"]
    assert handed[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert vectors.numbered(rows, "card").columns == ["card", "of", "more", "pos"]


def test_a_key_is_asked_once_for_its_ids():
    """Ids of few scans are one message each way; of many, those of a part; and each is forgotten when its own time is up."""
    calls = []

    class State(dict):
        def getValue(self, key):  # noqa: N802
            calls.append(key)
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            calls.append(key)
            self[key] = value

    held = scans.HeldScans(remembered=100)
    held.ids = State()
    few = [f"s{i}" for i in range(50)]
    assert held._new(few, 50, now=0) == set(few) and len(calls) == 2
    assert held._new([*few[:20], "t"], 51, now=60) == {"t"}
    assert held._new(few, 51, now=130) == set(few[20:])  # the first twenty came again at 60
    calls.clear()
    assert held._new(["t", "s7", "u"], 300, now=140) == {"u"} and len(calls) <= 1 + 2 * 3
    assert held._new(["t", "s7", "u"], 20_000, now=150) == set() and held._new(["u"], 20_000, now=251) == {"u"}
