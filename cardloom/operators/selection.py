"""Exact quantiles by distributed selection: no buffer holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's error, as one over a share of the rows: what is left to be sorted is some 6 / ACCURACY of them per quantile.
ACCURACY = 50_000


def exact_quantiles(rows: DataFrame, value: str, fractions: dict[str, float], *by: str, accuracy: int = ACCURACY) -> DataFrame:
    """by and a column per fraction: the quantile, linear between the two values next to its place; null where a group has no
    value. Nulls of ``value`` don't count; nulls of ``by`` are a group.

    A sketch of bounded size brackets each quantile by two values.  One more pass counts what lies below each bracket, and
    how often each different value inside one occurs; these alone are put in order, and the two at the sought places are
    taken.  A bracket that misses its place is an error, never a result."""
    names = list(fractions)
    d = rows.filter(F.col(value).isNotNull()).select(*[F.struct(*by).alias("_g") if by else F.lit(0).alias("_g")], F.col(value).cast("double").alias("_v"))
    slack = 2.0 / accuracy
    ends = [F.lit(min(1.0, max(0.0, f + s))) for f in fractions.values() for s in (-slack, slack)]
    # One place more on either side, as in small groups a place is a larger share than the slack.
    sketch = d.groupBy("_g").agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*ends), accuracy).alias("_s"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    small = F.col("_n") <= accuracy  # in a small group every bracket is the whole of it: at most so many values
    at = lambda i, f: F.struct(
        F.lit(i).alias("i"), F.floor((F.col("_n") - 1) * f).alias("low"), F.ceil((F.col("_n") - 1) * f).alias("high"), ((F.col("_n") - 1) * f).alias("place"),
        F.when(small, F.col("_lo")).otherwise(F.col("_s")[2 * i]).alias("from"), F.when(small, F.col("_hi")).otherwise(F.col("_s")[2 * i + 1]).alias("to"),
    )
    brackets = sketch.select("_g", F.explode(F.array(*[at(i, f) for i, f in enumerate(fractions.values())])).alias("b"))
    asked = brackets.groupBy("_g").agg(F.collect_list("b").alias("b"))  # as many as there are fractions
    met = d.join(asked, d["_g"].eqNullSafe(asked["_g"])).drop(asked["_g"])
    hit = met.select("_g", "_v", F.explode("b").alias("b")).filter(F.col("_v") <= F.col("b.to"))
    counted = hit.groupBy("_g", "b", F.when(F.col("_v") >= F.col("b.from"), F.col("_v")).alias("_v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_g", "b").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counted.withColumn("upto", upto)
    value_at = lambda k: F.max(F.when((F.col("upto") > F.col(f"b.{k}")) & (F.col("upto") - F.col("n") <= F.col(f"b.{k}")), F.col("_v")))
    found = placed.groupBy("_g", "b").agg(value_at("low").alias("x"), value_at("high").alias("y"))
    missed = F.col("x").isNull() | F.col("y").isNull()
    exact = F.when(missed, F.raise_error(F.lit("a bracket missed its quantile")).cast("double")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * (F.col("b.place") - F.col("b.low")))
    each = found.select("_g", F.col("b.i").alias("i"), exact.alias("q")).groupBy("_g").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    return each.select(*[F.col("_g")[c].alias(c) for c in by], *names)
