"""Search, identification and evaluation over the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import vectors as V
from cardloom.operators import evaluate as E
from cardloom.operators import vectors as O
from cardloom.plans import tables as T
from cardloom.plans.registry import SQL, query
from cardloom.sources.shared import made_once, new_path, passing, scratch
from cardloom.sources.snapshots import read_snapshot, write_snapshot

H = "WITH " + T.VECTORS_SQL
R = "WITH " + T.RESULTS_SQL
TOP5 = ", h5 AS (SELECT * FROM hits WHERE mode = 'base' AND rank <= 5)"


def r4(*columns):
    return [F.round(c, 4).alias(c) for c in columns]


@query("topk", H + "SELECT query_id, rank, pos, round(score, 4) AS score FROM hits WHERE mode = 'base' AND rank <= 5")
def topk(spark, sf):
    return O.topk(T.queries(spark, sf), T.index(spark, sf), 5).select("query_id", "rank", "pos", *r4("score"))


def blocked_index(spark, sf):
    """The vectors in blocks, which the application builds once."""
    return O.open_blocked_index(spark, made_once(spark, "blocked", (sf,), lambda path: O.block_index(T.index(spark, sf), path)))


@query("topk_pruned", H + "SELECT query_id, rank, pos, round(score, 4) AS score FROM hits WHERE mode = 'base' AND rank <= 5")
def topk_pruned(spark, sf):
    """The same search, which leaves out blocks of the index that can't hold a better row."""
    return O.topk_pruned(T.queries(spark, sf), blocked_index(spark, sf), 5).select("query_id", "rank", "pos", *r4("score"))


@query("topk_batch", H + "SELECT mode, query_id, rank, pos, round(score, 4) AS score FROM hits WHERE rank <= 10")
def topk_batch(spark, sf):
    parts = [O.topk(T.queries(spark, sf, m), T.index(spark, sf), 10).select(F.lit(m).alias("mode"), "query_id", "rank", "pos", *r4("score")) for m in ("base", "half")]
    return parts[0].unionByName(parts[1])


@query("query_x_index", H + "SELECT query_id, count(*) AS n, round(avg(score), 4) AS mean_score FROM scored WHERE mode = 'base' GROUP BY query_id")
def query_x_index(spark, sf):
    every = O.every_score(T.queries(spark, sf), T.index(spark, sf))
    return every.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("hit_to_metadata", H + "SELECT query_id, rank, pos, name FROM hits WHERE mode = 'base'")
def hit_to_metadata(spark, sf):
    return T.hits(spark, sf).select("query_id", "rank", "pos", "name")


@query("hit_metadata", H + "SELECT query_id, rank, pos, coalesce(name, '') AS name, false AS full_art, 0 AS face_index, string_split('a,' || name, ',') AS frame_effects FROM hits WHERE mode = 'base'")
def hit_metadata(spark, sf):
    effects = F.concat(F.lit("a,"), F.col("name"))
    rows = T.hits(spark, sf).select("query_id", "rank", "pos", F.coalesce("name", F.lit("")).alias("name"), F.lit(False).alias("full_art"), F.lit(0).alias("face_index"), effects.alias("e"))
    return rows.withColumn("frame_effects", F.when(F.col("e") == "", F.array().cast("array<string>")).otherwise(F.split("e", ","))).drop("e")


IDENTIFY = TOP5 + """ SELECT query_id, round(max(score), 4) AS similarity, CASE WHEN max(score) >= 0.7 THEN 'CONFIDENT' WHEN max(score) >= 0.4 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS confidence,
  list(pos ORDER BY rank) AS candidates FROM h5 GROUP BY query_id"""


@query("identify", H + IDENTIFY)
def identify(spark, sf):
    q = T.queries(spark, sf)
    return O.identify(q, O.topk(q, T.index(spark, sf), 5)).select("query_id", *r4("similarity"), "confidence", "candidates")


@query("candidate_fields", H + "SELECT query_id, rank, CAST(pos AS VARCHAR) AS scryfall_id, name, round(score, 4) AS similarity FROM hits WHERE mode = 'base' AND rank <= 5")
def candidate_fields(spark, sf):
    return T.hits(spark, sf, k=5).select("query_id", "rank", F.col("pos").cast("string").alias("scryfall_id"), "name", F.round("score", 4).alias("similarity"))


@query("name_gap", R + "SELECT query_id, round(name_gap, 4) AS name_gap FROM res WHERE mode = 'half'")
def name_gap(spark, sf):
    return O.name_gap(T.queries(spark, sf, "half"), T.hits(spark, sf, "half")).select("query_id", *r4("name_gap"))


@query("best_per_name", H + "SELECT query_id, name, round(max(score), 4) AS score FROM hits WHERE mode = 'base' GROUP BY query_id, name")
def best_per_name(spark, sf):
    return O.best_per_name(T.hits(spark, sf)).select("query_id", "name", *r4("score"))


@query("hit_ranks", R + "SELECT query_id, exact_rank, name_rank FROM res WHERE mode = 'half'")
def hit_ranks(spark, sf):
    return O.hit_ranks(T.queries(spark, sf, "half"), T.hits(spark, sf, "half"))


DECIDE = """, d AS (SELECT *, CASE WHEN top1_sim < 0.4 THEN 'NO_MATCH' WHEN top1_sim >= 0.6 AND name_gap >= 0.05 THEN 'CONFIDENT' ELSE 'AMBIGUOUS' END AS confidence FROM res)
SELECT query_id, confidence, round(top1_sim, 4) AS similarity, round(name_gap, 4) AS gap, CASE WHEN confidence <> 'NO_MATCH' THEN top1_pred_pos END AS pos,
  CASE WHEN confidence <> 'NO_MATCH' THEN top1_pred_name END AS name FROM d WHERE mode = '{}'"""


@query("decide_match", R + DECIDE.format("base"))
def decide_match(spark, sf):
    return O.decide_match(T.queries(spark, sf), T.hits(spark, sf)).select("query_id", "confidence", *r4("similarity", "gap"), "pos", "name")


@query("scan_multiple", R + DECIDE.format("half").replace("SELECT query_id, confidence", "SELECT query_id // 100 AS photo_id, query_id AS det_id, confidence"))
def scan_multiple(spark, sf):
    rows = O.decide_match(T.queries(spark, sf, "half"), T.hits(spark, sf, "half"))
    return rows.select(F.floor(F.col("query_id") / 100).alias("photo_id"), F.col("query_id").alias("det_id"), "confidence", *r4("similarity", "gap"), "pos", "name")


TURNED = ", up AS (SELECT query_id, max(score) AS s FROM hits WHERE mode = 'half' GROUP BY query_id), turned AS (SELECT query_id, max(score) AS s FROM hits WHERE mode = 'base' GROUP BY query_id)"


@query("best_orientation", H + TURNED + """ SELECT h.query_id, h.rank, h.pos, round(h.score, 4) AS score, h.mode = 'base' AS rotated FROM hits h JOIN up USING (query_id) JOIN turned USING (query_id)
WHERE h.rank <= 5 AND (h.mode = 'base') = (up.s < 0.9 AND turned.s > up.s)""")
def best_orientation(spark, sf):
    """The half vectors stand for upright views, the whole ones for turned."""
    q = T.queries(spark, sf, "half")
    index = T.index(spark, sf)
    upright = O.topk(q, index, 5)
    weak = upright.filter(f"rank = 1 and score < {O.RETRY}").select("query_id")
    rotated = O.topk(T.queries(spark, sf).join(weak, "query_id", "left_semi"), index, 5)
    return O.best_orientation(upright, rotated).select("query_id", "rank", "pos", *r4("score"), "rotated")


@query("inner_product", "SELECT a.vec_id AS a, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def inner_product(spark, sf):
    e = T.index(spark, sf)
    other = e.select((F.col("pos") - 1).alias("pos"), F.col("embedding").alias("other"))
    return e.join(other, "pos").select(F.col("pos").alias("a"), F.round(V.inner_product("embedding", "other"), 4).alias("p"))


COS = "list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))"


@query("cosine", "WITH p AS (SELECT a.vec_id AS a, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, round(" + COS.format(a="x", b="y") + ", 4) AS c FROM p")
def cosine(spark, sf):
    e = T.index(spark, sf)
    other = e.select((F.col("pos") - 1).alias("pos"), F.col("embedding").alias("other"))
    return e.join(other, "pos").select(F.col("pos").alias("a"), F.round(V.cosine("embedding", "other"), 4).alias("c"))


@query("l2_normalize", "WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings) SELECT vec_id, i - 1 AS place, v[i] / sqrt(list_inner_product(v, v)) AS value FROM e, range(1, 65) t(i)")
def l2_normalize(spark, sf):
    three = F.transform("embedding", lambda x: x.cast("double") * 3)
    return T.index(spark, sf).select(F.col("pos").alias("vec_id"), F.posexplode(V.l2_normalize(three)).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query("pixel_normalize", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x / 127.5 - 1, 4)) AS v FROM embeddings")
def pixel_normalize(spark, sf):
    return T.index(spark, sf).select(F.col("pos").alias("vec_id"), F.transform(V.pixel_normalize(F.col("embedding").cast("array<double>")), lambda x: F.round(x, 4)).alias("v"))


@query("classify_confidence", H + "SELECT query_id, rank, CASE WHEN score >= 0.7 THEN 'CONFIDENT' WHEN score >= 0.4 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS confidence FROM hits WHERE mode = 'base'")
def classify_confidence(spark, sf):
    return T.hits(spark, sf).select("query_id", "rank", O.classify_confidence(F.col("score")).alias("confidence"))


@query("similarity_pct", H + "SELECT query_id, rank, CAST(floor(score * 100 + 0.5) AS INTEGER) AS pct FROM hits WHERE mode = 'base'")
def similarity_pct(spark, sf):
    return T.hits(spark, sf).select("query_id", "rank", V.similarity_pct(F.col("score")).alias("pct"))


FIELDS = ("top1_exact", "top1_name", "top1_pred_name", "top1_pred_pos", "exact_rank", "name_rank")


@query("eval_layer1", R + f"SELECT mode, query_id, {', '.join(FIELDS)}, round(top1_sim, 4) AS top1_sim, round(name_gap, 4) AS name_gap FROM res")
def eval_layer1(spark, sf):
    return T.results(spark, sf).select("mode", "query_id", *FIELDS, *r4("top1_sim", "name_gap"))


PCT = "round(100 * avg(CAST({} AS INTEGER)), 4) AS {}"
OVERALL = "count(*) AS n, count_if(top1_name) AS names, count_if(top1_exact) AS exacts, " + ", ".join(PCT.format(f"{c}", f"{n}_pct") for c, n in (("top1_name", "name"), ("top1_exact", "exact"), ("detected", "detected")))


@query("eval_overall", R + f"SELECT {OVERALL} FROM res")
def eval_overall(spark, sf):
    return E.overall(T.results(spark, sf))


@query("eval_similarity_stats", R + "SELECT top1_name, count(*) AS n, round(avg(top1_sim), 4) AS mean, round(min(top1_sim), 4) AS min, round(max(top1_sim), 4) AS max, round(stddev_samp(top1_sim), 4) AS std FROM res GROUP BY top1_name")
def eval_similarity_stats(spark, sf):
    return E.similarity_stats(T.results(spark, sf)).select("top1_name", "n", *r4("mean", "min", "max", "std"))


@query("eval_gap_stats", R + "SELECT top1_name, round(avg(name_gap), 4) AS mean, round(min(name_gap), 4) AS min, round(median(name_gap), 4) AS median FROM res GROUP BY top1_name")
def eval_gap_stats(spark, sf):
    return E.gap_stats(T.results(spark, sf)).select("top1_name", *r4("mean", "min", "median"))


@query("eval_threshold_grid", R + """, g AS (SELECT s.sim, g.gap FROM (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) s(sim), (VALUES (0.0), (0.02), (0.05), (0.1)) g(gap))
SELECT CAST(sim AS DOUBLE) AS sim, CAST(gap AS DOUBLE) AS gap, count(*) AS qualified, round(100 * avg(CAST(top1_name AS INTEGER)), 4) AS accuracy, round(100.0 * count(*) / (SELECT count(*) FROM res), 4) AS coverage
FROM g JOIN res ON top1_sim >= sim AND name_gap >= gap GROUP BY sim, gap HAVING 100 * avg(CAST(top1_name AS INTEGER)) >= 99""")
def eval_threshold_grid(spark, sf):
    return E.threshold_grid(T.results(spark, sf))


@query("eval_rank_distribution", R + """ SELECT top, count_if(CASE WHEN top = -1 THEN exact_rank = -1 ELSE exact_rank > 0 AND exact_rank <= top END) AS exacts,
  count_if(CASE WHEN top = -1 THEN name_rank = -1 ELSE name_rank > 0 AND name_rank <= top END) AS names,
  round(100.0 * count_if(CASE WHEN top = -1 THEN exact_rank = -1 ELSE exact_rank > 0 AND exact_rank <= top END) / count(*), 4) AS exact_pct,
  round(100.0 * count_if(CASE WHEN top = -1 THEN name_rank = -1 ELSE name_rank > 0 AND name_rank <= top END) / count(*), 4) AS name_pct
FROM res, (VALUES (-1), (1), (3), (5), (10), (20)) t(top) GROUP BY top""")
def eval_rank_distribution(spark, sf):
    return E.rank_distribution(T.results(spark, sf))


BREAK = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, * FROM res" for d in E.DIMENSIONS)


@query("eval_breakdown", R + f", u AS ({BREAK}) SELECT dimension, value, count(*) AS n, {PCT.format('top1_name', 'name_pct')}, {PCT.format('top1_exact', 'exact_pct')}, round(avg(top1_sim), 4) AS mean_sim, round(avg(name_gap), 4) AS mean_gap FROM u WHERE trim(coalesce(value, '')) <> '' GROUP BY dimension, value")
def eval_breakdown(spark, sf):
    return E.breakdown(T.results(spark, sf)).select("dimension", "value", "n", "name_pct", "exact_pct", *r4("mean_sim", "mean_gap"))


@query("eval_face_breakdown", R + f"SELECT face_index, CASE WHEN face_index = 0 THEN 'front' ELSE 'back' END AS face, count(*) AS n, {PCT.format('top1_name', 'name_pct')}, {PCT.format('top1_exact', 'exact_pct')} FROM res GROUP BY face_index")
def eval_face_breakdown(spark, sf):
    return E.face_breakdown(T.results(spark, sf))


@query("eval_compare_modes", R + "SELECT mode, count(*) AS n, count_if(top1_name) AS names, count_if(top1_exact) AS exacts, round(avg(top1_sim), 4) AS mean_sim, round(avg(name_gap), 4) AS mean_gap FROM res GROUP BY mode")
def eval_compare_modes(spark, sf):
    return E.compare_modes(T.results(spark, sf)).select("mode", "n", "names", "exacts", *r4("mean_sim", "mean_gap"))


PAIRS = ", b AS (SELECT * FROM res WHERE mode = 'base'), o AS (SELECT * FROM res WHERE mode = 'half') "


@query("eval_pair_modes", R + PAIRS + "SELECT query_id, b.top1_name AS b_name, o.top1_name AS o_name, round(b.top1_sim, 4) AS b_sim, round(o.top1_sim, 4) AS o_sim FROM b FULL JOIN o USING (query_id)")
def eval_pair_modes(spark, sf):
    p = E.pair_modes(T.results(spark, sf), "base", "half")
    return p.select("query_id", F.col("b_top1_name").alias("b_name"), F.col("o_top1_name").alias("o_name"), F.round("b_top1_sim", 4).alias("b_sim"), F.round("o_top1_sim", 4).alias("o_sim"))


@query("eval_divergence", R + PAIRS + """SELECT count_if(b.top1_name AND o.top1_name) AS both_right, count_if(b.top1_name AND NOT o.top1_name) AS base_only, count_if(NOT b.top1_name AND o.top1_name) AS other_only,
  count_if(NOT b.top1_name AND NOT o.top1_name) AS both_wrong, count_if(b.top1_exact AND NOT o.top1_exact) AS exact_lost FROM b JOIN o USING (query_id)""")
def eval_divergence(spark, sf):
    return E.divergence(T.results(spark, sf), "base", "half")


@query("paired_contingency", R + PAIRS + """SELECT count_if(b.top1_name AND o.top1_name) AS both, count_if(b.top1_name AND NOT o.top1_name) AS only_base, count_if(NOT b.top1_name AND o.top1_name) AS only_other,
  count_if(NOT b.top1_name AND NOT o.top1_name) AS neither, round(100 * avg(CAST(b.top1_name AS INTEGER)), 4) AS base_pct, round(100 * avg(CAST(o.top1_name AS INTEGER)), 4) AS other_pct FROM b JOIN o USING (query_id)""")
def paired_contingency(spark, sf):
    return E.contingency(T.results(spark, sf), "base", "half")


@query("failure_class", "WITH " + T.TAIL_SQL + PAIRS.replace("'half'", "'tail'") + """SELECT query_id, CASE WHEN NOT o.top1_name THEN 'name_wrong' ELSE 'exact_wrong' END AS failure, b.top1_name AND NOT o.top1_name AS detection_caused,
  round(b.top1_sim - o.top1_sim, 4) AS sim_drop FROM b JOIN o USING (query_id) WHERE NOT o.top1_name OR NOT o.top1_exact""")
def failure_class(spark, sf):
    """The other mode knows four numbers of a query only, so that many fail."""
    return E.failure_class(T.results(spark, sf, "tail"), "base", "tail").select("query_id", "failure", "detection_caused", *r4("sim_drop"))


@query("results_to_manifest", R + "SELECT m.query_id, m.frame, r.top1_name FROM res m JOIN res r ON m.query_id = r.query_id WHERE m.mode = 'base' AND r.mode = 'half'")
def results_to_manifest(spark, sf):
    rows = T.results(spark, sf)
    manifest = rows.filter("mode = 'base'").select("query_id", "frame")
    return manifest.join(rows.filter("mode = 'half'").select("query_id", "top1_name"), "query_id")


@query("similarity_percentiles", R + """SELECT round(quantile_cont(top1_sim, 0.0), 4) AS min, round(quantile_cont(top1_sim, 0.05), 4) AS p5, round(quantile_cont(top1_sim, 0.5), 4) AS median, round(quantile_cont(top1_sim, 0.95), 4) AS p95,
  round(quantile_cont(top1_sim, 1.0), 4) AS max, count_if(top1_sim < 0.9) AS below_90, count_if(top1_sim < 0.85) AS below_85 FROM res WHERE top1_name""")
def similarity_percentiles(spark, sf):
    return E.similarity_percentiles(T.results(spark, sf)).select(*r4("min", "p5", "median", "p95", "max"), "below_90", "below_85")


REAL = DECIDE.split("SELECT query_id")[0]


@query("real_eval_summary", R + REAL + """SELECT count(*) AS processed, count(*) AS detected, count_if(confidence = 'CONFIDENT') AS confident, count_if(confidence = 'AMBIGUOUS') AS ambiguous,
  count_if(confidence = 'NO_MATCH') AS no_match, count_if(confidence <> 'NO_MATCH' AND top1_name) AS "right", count_if(NOT (confidence <> 'NO_MATCH' AND top1_name)) AS wrong FROM d WHERE mode = 'half'""")
def real_eval_summary(spark, sf):
    rows = O.decide_match(T.queries(spark, sf, "half"), T.hits(spark, sf, "half")).join(T.queries(spark, sf, "half").select("query_id", "gt_name"), "query_id")
    return E.real_summary(rows.withColumns({"detected": F.lit(True), "name_right": F.coalesce(F.col("name") == F.col("gt_name"), F.lit(False))}))


@query("real_eval", R + REAL + """SELECT query_id AS path, CASE WHEN query_id % 100 = 0 THEN NULL ELSE confidence <> 'NO_MATCH' AND top1_name END AS name_right,
  CASE WHEN query_id % 100 <> 0 THEN gt_name END AS truth_name FROM d WHERE mode = 'half'""")
def real_eval(spark, sf):
    rows = O.decide_match(T.queries(spark, sf, "half"), T.hits(spark, sf, "half"))
    decided = rows.select(F.col("query_id").alias("path"), "confidence", "name", F.lit("set").alias("set_code"), F.col("pos").cast("string").alias("collector_number"))
    truth = T.queries(spark, sf).filter("query_id % 100 <> 0").select(F.col("query_id").alias("path"), F.col("gt_name").alias("name"), F.lit("set").alias("set_code"), F.lit("1").alias("collector_number"))
    return E.real_eval(decided, truth).select("path", "name_right", "truth_name")


@query("gt_to_predictions", R + "SELECT query_id, top1_pred_name AS predicted, CASE WHEN query_id % 100 <> 0 THEN gt_name END AS gt_name FROM res WHERE mode = 'base'")
def gt_to_predictions(spark, sf):
    truth = T.queries(spark, sf).filter("query_id % 100 <> 0").select("query_id", "gt_name")
    return T.results(spark, sf).filter("mode = 'base'").select("query_id", F.col("top1_pred_name").alias("predicted")).join(truth, "query_id", "left")


@query("parity_report", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i = 1 THEN x * 0.5 ELSE x END) AS x FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, """ + COS.format(a="x", b="y") + """ AS cos FROM e),
s AS (SELECT e.vec_id, i.vec_id AS pos, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_inner_product(x, CAST(i.embedding AS DOUBLE[])), 12) DESC, i.vec_id) AS rank FROM e, embeddings i)
SELECT (SELECT count(*) FROM c) AS n, (SELECT round(avg(cos), 4) FROM c) AS mean_cosine, (SELECT round(min(cos), 4) FROM c) AS min_cosine, (SELECT vec_id FROM c ORDER BY cos, vec_id LIMIT 1) AS worst,
  (SELECT count_if(pos = vec_id) FROM s WHERE rank = 1) AS self_matches, (SELECT min(cos) > 0.99 FROM c) AS passed""")
def parity_report(spark, sf):
    """New vectors: the stored ones with their first number halved."""
    index = T.index(spark, sf)
    fresh = index.filter("pos % 50 = 0").select("pos", F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when(i == 0, x * 0.5).otherwise(x)).alias("embedding"))
    return O.parity_report(fresh, index).select("n", *r4("mean_cosine", "min_cosine"), "worst", "self_matches", "passed")


@query("backend_agreement", """WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS a, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 2)) AS b, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 1)) AS c FROM embeddings)
SELECT round(avg(""" + COS.format(a="a", b="b") + "), 4) AS cos_ab, round(avg(" + COS.format(a="a", b="c") + "), 4) AS cos_ac, round(avg(" + COS.format(a="b", b="c") + "), 4) AS cos_bc FROM e")
def backend_agreement(spark, sf):
    whole = F.col("embedding").cast("array<double>")
    rows = T.index(spark, sf).select(whole.alias("a"), F.transform(whole, lambda x: F.round(x, 2)).alias("b"), F.transform(whole, lambda x: F.round(x, 1)).alias("c"))
    return O.backend_agreement(rows).select(*r4("cos_ab", "cos_ac", "cos_bc"))


@query("build_index", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, len(embedding) AS dim FROM embeddings")
def build_index(spark, sf):
    built = O.numbered(O.build_index(T.index(spark, sf).drop("name"), 64).withColumnRenamed("pos", "vec_id"), "vec_id")
    return built.select("vec_id", "pos", F.size("embedding").cast("long").alias("dim"))


@query("append_positions", "SELECT vec_id, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS pos FROM embeddings")
def append_positions(spark, sf):
    """Even rows are indexed, odd ones come after."""
    rows = T.index(spark, sf).select(F.col("pos").alias("vec_id"))
    old, new = O.numbered(rows.filter("vec_id % 2 = 0"), "vec_id"), rows.filter("vec_id % 2 = 1")
    return O.append_index(old, new, "vec_id")


@query("append_index", "SELECT vec_id, CASE vec_id % 2 WHEN 0 THEN 'old' ELSE 'new' END AS part, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS pos FROM embeddings")
def append_index(spark, sf):
    rows = T.index(spark, sf).select(F.col("pos").alias("vec_id"), F.when(F.col("pos") % 2 == 0, "old").otherwise("new").alias("part"))
    return O.append_index(O.numbered(rows.filter("part = 'old'"), "vec_id"), rows.filter("part = 'new'"), "vec_id").select("vec_id", "part", "pos")


@query("append_index_snapshot", SQL["append_index"])
def append_index_snapshot(spark, sf):
    """The same between two snapshots of a stored index: readers see the old positions or all of the new ones."""
    rows = T.index(spark, sf).select(F.col("pos").alias("vec_id"), F.when(F.col("pos") % 2 == 0, "old").otherwise("new").alias("part"))
    path = new_path(spark, "index")
    with scratch(spark, "append"):
        first = write_snapshot(O.numbered(rows.filter("part = 'old'"), "vec_id"), path, None)
        write_snapshot(O.append_index(read_snapshot(spark, path), rows.filter("part = 'new'"), "vec_id"), path, first.number)
    passing(spark, path)
    return read_snapshot(spark, path).select("vec_id", "part", "pos")


def _double():
    def predict(inputs):
        return inputs * 2.0

    return predict


@query("embed_batch", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(list_inner_product(v, v) / sqrt(list_inner_product(v, v)), 4) AS p FROM e")
def embed_batch(spark, sf):
    """A model that doubles its input: after normalising, the vector itself."""
    rows = T.index(spark, sf).select(F.col("pos").alias("vec_id"), F.col("embedding").alias("input"))
    return O.embed_batch(rows, _double, "input").select("vec_id", F.round(V.inner_product("embedding", "input"), 4).alias("p"))


@query("incremental_index", "SELECT vec_id, row_number() OVER (ORDER BY vec_id % 3 = 0, vec_id) - 1 AS pos, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / CASE WHEN vec_id % 3 = 0 THEN sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) ELSE 1 END, 4) AS p FROM embeddings")
def incremental_index(spark, sf):
    """What isn't indexed is embedded and appended."""
    rows = T.index(spark, sf).select(F.col("pos").alias("vec_id"), F.col("embedding").alias("input"))
    old = O.numbered(rows.filter("vec_id % 3 <> 0").withColumn("embedding", F.col("input").cast("array<double>")), "vec_id")
    fresh = O.embed_batch(rows.join(old.select("vec_id"), "vec_id", "left_anti"), _double, "input")
    whole = O.append_index(old.drop("input"), fresh.drop("input"), "vec_id")
    return whole.join(rows, "vec_id").select("vec_id", "pos", F.round(V.inner_product("embedding", "input"), 4).alias("p"))
