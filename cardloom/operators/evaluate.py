"""Evaluation of identification results: per-query metrics and the reports over them.

Results are rows of one query each; reports are single grouped aggregations, whatever the number of thresholds or
dimensions: threshold grids are cumulative counts of cells, rank limits a small theta join, dimensions are unpivoted, and
percentiles are selected exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.selection import exact_quantiles
from cardloom.operators.vectors import hit_ranks, name_gap

SIMS, GAPS = (0.5, 0.6, 0.7, 0.8, 0.9), (0.0, 0.02, 0.05, 0.1)
RANKS = (1, 3, 5, 10, 20)
DIMENSIONS = ("frame", "border_color", "layout", "rarity", "category")


def layer1(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """truth (query_id, gt_name, gt_pos, ...) and hits (query_id, rank, pos, name, score): top1_exact, top1_name, top1_sim,
    top1_pred_name, top1_pred_pos, name_gap, exact_rank, name_rank for every query; without hits False, 0, null, 0, -1."""
    top = hits.filter("rank = 1").select("query_id", F.col("score").alias("sim"), F.col("name").alias("pred_name"), F.col("pos").alias("pred_pos"))
    rows = truth.join(top, "query_id", "left").join(name_gap(truth, hits), "query_id").join(hit_ranks(truth, hits), "query_id")
    return rows.select(
        *truth.columns,
        F.coalesce(F.col("pred_pos") == F.col("gt_pos"), F.lit(False)).alias("top1_exact"), F.coalesce(F.col("pred_name") == F.col("gt_name"), F.lit(False)).alias("top1_name"),
        F.coalesce("sim", F.lit(0.0)).alias("top1_sim"), F.col("pred_name").alias("top1_pred_name"), F.col("pred_pos").alias("top1_pred_pos"), "name_gap", "exact_rank", "name_rank",
    )


def _pct(flag: str):
    return F.round(100 * F.avg(F.col(flag).cast("double")), 4)


def overall(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n"), F.count_if(F.col("top1_name")).alias("names"), F.count_if(F.col("top1_exact")).alias("exacts"), _pct("top1_name").alias("name_pct"), _pct("top1_exact").alias("exact_pct"), _pct("detected").alias("detected_pct"))


def similarity_stats(results: DataFrame) -> DataFrame:
    s = "top1_sim"
    return results.groupBy("top1_name").agg(F.count("*").alias("n"), F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max"), F.stddev_samp(s).alias("std"))


def gap_stats(results: DataFrame) -> DataFrame:
    each = results.groupBy("top1_name").agg(F.avg("name_gap").alias("mean"), F.min("name_gap").alias("min"))
    middle = exact_quantiles(results, "name_gap", {"median": 0.5}, "top1_name")
    right = F.col("top1_name").eqNullSafe(F.col("_of"))
    return each.join(middle.withColumnRenamed("top1_name", "_of"), right, "left").select("top1_name", "mean", "min", "median")


def threshold_grid(results: DataFrame, least_accuracy: float = 99.0, sims=SIMS, gaps=GAPS) -> DataFrame:
    """For each (sim, gap): rows that reach both, their name accuracy, and their share; pairs with too low accuracy go.

    Each row falls into one cell, by how many thresholds of either kind it reaches; the cells are counted in one
    aggregation, and only these few are then added up to the grid's corners."""
    sims, gaps = sorted(set(sims)), sorted(set(gaps))
    reached = lambda c, limits: reduce(lambda a, b: a + b, [F.coalesce((F.col(c) >= x).cast("int"), F.lit(0)) for x in limits])
    right, known = F.count_if(F.col("top1_name")).alias("right"), F.count("top1_name").alias("known")
    cells = results.groupBy(reached("top1_sim", sims).alias("i"), reached("name_gap", gaps).alias("j")).agg(F.count("*").alias("n"), right, known)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    below = lambda values, c: F.explode(F.slice(F.array(*[F.lit(float(x)) for x in values]), F.lit(1), F.col(c)))
    corners = cells.withColumn("total", total).withColumn("sim", below(sims, "i")).withColumn("gap", below(gaps, "j"))
    each = corners.groupBy("sim", "gap").agg(F.sum("n").alias("qualified"), F.round(100 * F.sum("right") / F.sum("known"), 4).alias("accuracy"), F.max("total").alias("total"))
    return each.filter(F.col("accuracy") >= least_accuracy).select("sim", "gap", "qualified", "accuracy", F.round(100 * F.col("qualified") / F.col("total"), 4).alias("coverage"))


def rank_distribution(results: DataFrame) -> DataFrame:
    """Within each rank limit, exact and name counts and percentages; limit -1 counts what isn't among the hits at all."""
    limits = results.sparkSession.createDataFrame([(r,) for r in (-1, *RANKS)], "top int")
    inside = lambda c: F.when(F.col("top") == -1, F.col(c) == -1).otherwise((F.col(c) > 0) & (F.col(c) <= F.col("top")))
    pairs = results.groupBy("exact_rank", "name_rank").agg(F.count("*").alias("n"))  # as few as there are ranks
    rows = pairs.join(F.broadcast(limits))
    hits = lambda c: F.coalesce(F.sum(F.when(inside(c), F.col("n"))), F.lit(0))
    pct = lambda c: F.round(100 * hits(c) / F.sum("n"), 4)
    return rows.groupBy("top").agg(hits("exact_rank").alias("exacts"), hits("name_rank").alias("names"), pct("exact_rank").alias("exact_pct"), pct("name_rank").alias("name_pct"))


def breakdown(results: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Per dimension and value: n, name and exact percentages, mean similarity and gap. Blank values are skipped."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    rows = results.select(pairs.alias("d"), "top1_name", "top1_exact", "top1_sim", "name_gap").select("d.*", "top1_name", "top1_exact", "top1_sim", "name_gap")
    rows = rows.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"), _pct("top1_name").alias("name_pct"), _pct("top1_exact").alias("exact_pct"), F.avg("top1_sim").alias("mean_sim"), F.avg("name_gap").alias("mean_gap"))


def face_breakdown(results: DataFrame) -> DataFrame:
    label = F.when(F.col("face_index") == 0, "front").otherwise("back")
    return results.groupBy("face_index").agg(F.first(label).alias("face"), F.count("*").alias("n"), _pct("top1_name").alias("name_pct"), _pct("top1_exact").alias("exact_pct"))


def compare_modes(results: DataFrame) -> DataFrame:
    return results.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("top1_name")).alias("names"), F.count_if(F.col("top1_exact")).alias("exacts"), F.avg("top1_sim").alias("mean_sim"), F.avg("name_gap").alias("mean_gap"))


def pair_modes(results: DataFrame, base: str, other: str, key: str = "query_id") -> DataFrame:
    """Rows of two modes side by side, joined by key (never by position): b_... and o_... columns."""
    side = lambda mode, mark: results.filter(F.col("mode") == mode).select(key, *[F.col(c).alias(mark + c) for c in results.columns if c not in (key, "mode")])
    return side(base, "b_").join(side(other, "o_"), key, "full")


def divergence(results: DataFrame, base: str, other: str) -> DataFrame:
    b, o = F.coalesce("b_top1_name", F.lit(False)), F.coalesce("o_top1_name", F.lit(False))
    lost = F.coalesce("b_top1_exact", F.lit(False)) & ~F.coalesce("o_top1_exact", F.lit(False))
    counts = {"both_right": b & o, "base_only": b & ~o, "other_only": ~b & o, "both_wrong": ~b & ~o, "exact_lost": lost}
    return pair_modes(results, base, other).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def contingency(results: DataFrame, base: str, other: str) -> DataFrame:
    """Two methods on the same queries: 2 x 2 counts and both accuracies."""
    b, o = F.col("b_top1_name"), F.col("o_top1_name")
    pairs = pair_modes(results, base, other).filter(b.isNotNull() & o.isNotNull())
    return pairs.agg(F.count_if(b & o).alias("both"), F.count_if(b & ~o).alias("only_base"), F.count_if(~b & o).alias("only_other"), F.count_if(~b & ~o).alias("neither"), _pct("b_top1_name").alias("base_pct"), _pct("o_top1_name").alias("other_pct"))


def disagreements(results: DataFrame, base: str, other: str) -> DataFrame:
    return pair_modes(results, base, other).filter(F.col("b_top1_name") != F.col("o_top1_name"))


def failure_class(results: DataFrame, base: str, other: str) -> DataFrame:
    """Per query of ``other`` that isn't wholly right: name_wrong, exact_wrong; detection_caused where the base mode had
    the name right; sim_drop is the base mode's similarity less this one's."""
    pairs = pair_modes(results, base, other).filter(F.col("o_top1_name").isNotNull())
    kind = F.when(~F.col("o_top1_name"), "name_wrong").when(~F.col("o_top1_exact"), "exact_wrong")
    caused = F.coalesce(F.col("b_top1_name") & ~F.col("o_top1_name"), F.lit(False))
    return pairs.select("query_id", kind.alias("failure"), caused.alias("detection_caused"), (F.col("b_top1_sim") - F.col("o_top1_sim")).alias("sim_drop")).filter("failure is not null")


def similarity_percentiles(results: DataFrame) -> DataFrame:
    """Of correct matches: least, 5th, 50th, 95th percentile, largest similarity, and how many lie below 0.90 and 0.85."""
    right = results.filter("top1_name")
    row = right.agg(F.min("top1_sim").alias("min"), F.max("top1_sim").alias("max"), F.count_if(F.col("top1_sim") < 0.9).alias("below_90"), F.count_if(F.col("top1_sim") < 0.85).alias("below_85"))
    inner = exact_quantiles(right, "top1_sim", {"p5": 0.05, "median": 0.5, "p95": 0.95})
    return row.join(F.broadcast(inner), F.lit(True), "left").select("min", "p5", "median", "p95", "max", "below_90", "below_85")


def real_summary(results: DataFrame) -> DataFrame:
    """Counts of processed and detected images, of each confidence, and of right and wrong names among the scored."""
    levels = [F.count_if(F.col("confidence") == x).alias(x.lower()) for x in ("CONFIDENT", "AMBIGUOUS", "NO_MATCH")]
    scored = F.col("name_right").isNotNull()
    return results.agg(F.count("*").alias("processed"), F.count_if(F.col("detected")).alias("detected"), *levels, F.count_if(F.col("name_right")).alias("right"), F.count_if(scored & ~F.col("name_right")).alias("wrong"))


def real_eval(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """decided (path, confidence, name, set_code, collector_number) scored against truth (path, and the same three): a
    right name takes the predicted name, set and number as truth, a wrong one keeps the old, a row without truth is
    unscored."""
    from cardloom.functions.text import normalize_name

    t = truth.select("path", *[F.col(c).alias(f"t_{c}") for c in ("name", "set_code", "collector_number")])
    right = F.when(F.col("t_name").isNotNull(), F.coalesce(normalize_name(F.col("name")) == normalize_name(F.col("t_name")), F.lit(False)))
    joined = decided.join(t, "path", "left").withColumn("name_right", right)
    new = lambda c: F.when(F.col("name_right"), F.coalesce(c, f"t_{c}")).otherwise(F.col(f"t_{c}")).alias(f"truth_{c}")
    return joined.select(*decided.columns, "name_right", new("name"), new("set_code"), new("collector_number"))
