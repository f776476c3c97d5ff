"""Profiles of a catalogue: counts with shares, cross tables, printings per name, status breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.operators.selection import exact_quantiles

PRINTINGS = (1, 2, 3, 5, 10, 20, 50)


def pct(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole, 4)


def value_counts(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Per dimension and value: n and its share of all rows; nulls have no row but count in the whole."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    total = rows.agg(F.count("*").alias("total"))
    each = rows.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(total)).select("dimension", "value", "n", pct(F.col("n"), F.col("total")).alias("pct"))


def counts_desc(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Most common values first, ties by value."""
    out = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if most is None else out.limit(most)


def effect_counts(rows: DataFrame, column: str = "frame_effects") -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))
    each = rows.select(F.explode(column).alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))
    return each.join(F.broadcast(total)).select("effect", "n", pct(F.col("n"), F.col("total")).alias("pct"))


def multi_printing_thresholds(rows: DataFrame, name: str = "name") -> DataFrame:
    """How many names have at least t rows, and their share of all names."""
    limits = rows.sparkSession.createDataFrame([(t,) for t in PRINTINGS], "t int")
    each = rows.groupBy(name).agg(F.count("*").alias("c"))
    return each.join(F.broadcast(limits)).groupBy("t").agg(F.count_if(F.col("c") >= F.col("t")).alias("names"), pct(F.count_if(F.col("c") >= F.col("t")), F.count("*")).alias("pct"))


def most_printed(rows: DataFrame, most: int = 20, name: str = "name") -> DataFrame:
    """The names with most rows, ties by name."""
    return rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(most)


def cross_counts(rows: DataFrame, a: str, b: str) -> DataFrame:
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(a, b).agg(F.count("*").alias("n")).join(F.broadcast(total)).select(a, b, "n", pct(F.col("n"), F.col("total")).alias("pct"))


def set_diversity(rows: DataFrame) -> DataFrame:
    each = rows.groupBy("set_code").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("sets"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") < 10).alias("below_10"), F.count_if(F.col("n") >= 100).alias("from_100"), F.max("n").alias("largest"))


def crosstab_margins(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both columns' values with margins (``All``), long; rows with a null in either are left out."""
    known = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cube = known.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    named = lambda c, g: F.when(F.col(g) == 1, "All").otherwise(F.col(c).cast("string")).alias(c)
    return cube.select(named(a, "_a"), named(b, "_b"), "n")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Per upstream status (MISSING_FIELD where null): n, languages, and how many have faces and images."""
    return rows.groupBy(F.coalesce(status, F.lit("MISSING_FIELD")).alias("status")).agg(
        F.count("*").alias("n"), F.count_distinct("lang").alias("languages"), F.count_if(F.col("has_faces")).alias("with_faces"), F.count_if(F.col("has_image")).alias("with_image")
    )


def filter_status(rows: DataFrame, *wanted: str, status: str = "status") -> DataFrame:
    return rows.filter(F.coalesce(status, F.lit("unknown")).isin(*wanted))


def status_lookup(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    return rows.join(statuses.select("id", "status"), "id", "left")


def file_size_stats(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (filename) against files (filename, length): how many exist, and their sizes."""
    rows = names.join(files, "filename", "left")
    size = F.col("length")
    each = rows.agg(F.count(size).alias("present"), F.count_if(size.isNull()).alias("missing"), F.min(size).alias("min"), F.max(size).alias("max"), F.round(F.avg(size), 4).alias("mean"))
    return each.join(F.broadcast(exact_quantiles(rows, "length", {"median": 0.5})), F.lit(True), "left")


def class_breakdown(rows: DataFrame, by: str = "set_code", most: int | None = 10) -> DataFrame:
    """Per category its most common sets (or all its languages, ``?`` where unknown), with counts, and the category's size
    and the ranges of both scores."""
    named = rows.withColumn(by, F.coalesce(by, F.lit("?"))) if by == "lang" else rows
    ends = {f"{f}_{c}": (g, c) for c in ("score", "second") for f, g in (("min", F.min), ("max", F.max))}
    each = named.groupBy("category", by).agg(F.count("*").alias("n"), *[g(c).alias(f"_{x}") for x, (g, c) in ends.items()])
    of = Window.partitionBy("category")
    ranked = each.withColumns({"place": F.row_number().over(of.orderBy(F.desc("n"), by)), "total": F.sum("n").over(of)} | {x: g(f"_{x}").over(of) for x, (g, _) in ends.items()})
    return (ranked if most is None else ranked.filter(F.col("place") <= most)).select("category", "place", by, "n", "total", *ends)


def score_gap(rows: DataFrame) -> DataFrame:
    """Least score of positives less the largest of negatives."""
    return rows.agg((F.min(F.when(F.col("positive"), F.col("score"))) - F.max(F.when(~F.col("positive"), F.col("score")))).alias("gap"))


def category_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("images"), F.count_distinct("set_code").alias("sets"), F.count_distinct("name").alias("names"))


def database_summary(rows: DataFrame) -> DataFrame:
    levels = [F.count_if(F.col("image_status") == s).alias(s) for s in ("valid", "placeholder", "missing")]
    return rows.agg(F.count("*").alias("total"), *levels, F.count_distinct("set_code").alias("sets"))


def distinct_artifacts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.agg(*[F.count_distinct(c).alias(c) for c in columns])


def ocr_rates(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """rows (pool, text, name, number): per pool, and over all (null pool), how often the text resembles the name, and holds
    the number. Each pair of texts is compared once, and only where their lengths and letters leave the ratio possible."""
    from cardloom.functions.text import fuzzy_ratio

    pairs = rows.select("pool", F.lower("text").alias("a"), F.lower("name").alias("b"), F.contains("text", F.col("number")).alias("numbered"))
    pairs = pairs.groupBy("pool", "a", "b").agg(F.count("*").alias("n"), F.count_if("numbered").alias("numbered"))
    hit = pairs.withColumn("named", F.coalesce(fuzzy_ratio("a", "b", F.lit(least)) >= least, F.lit(False)))
    share = lambda c: F.round(100 * F.sum(c) / F.sum("n"), 4)
    return hit.rollup("pool").agg(F.sum("n").alias("n"), share(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("name_pct"), share(F.col("numbered")).alias("number_pct"))
