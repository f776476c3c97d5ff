"""Ranked search by name and by set and number, for one query or a table of queries, over a stored inverted index."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions.text import natural_order, number_key, parse_set_number, search_rank
from cardloom.operators.vectors import numbered
from cardloom.sources.shared import new_path, passing

LIMIT = 50
LEAST = 2
#: Rows of the catalogue whose positions one row of postings can hold.
CHUNK = 1 << 14
_TABLES = ("names", "postings", "counts")


class NameIndex(NamedTuple):
    """names: a catalogue's columns, the lower-cased name, the key of set and number, and the row's place in the order of
    results. postings: the positions of a gram's names, ascending, in chunks. counts: how many names have a gram."""

    names: DataFrame
    postings: DataFrame
    counts: DataFrame


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n))))


def build_name_index(catalog: DataFrame, path: str) -> NameIndex:
    """Writes the index of a catalogue (pos, scryfall_id, name, set_code, collector_number, lang) under ``path``: every run of
    two and of three characters of each lower-cased name. Names of equal rank come by name, set and number as a reader
    sorts them, then by pos; that order is found once, here."""
    spark = catalog.sparkSession
    kinds = ("pos", "scryfall_id", "name", "set_code", "collector_number", "lang")
    names = catalog.select(*kinds, F.lower("name").alias("lower"), number_key(F.col("set_code"), F.col("collector_number")).alias("number_key"))
    order = [natural_order(F.col(c)) for c in ("name", "set_code", "collector_number")]
    numbered(names, *order, "pos", name="sorted").write.parquet(f"{path}/names")
    runs = F.array_union(_grams(F.col("lower"), 2), _grams(F.col("lower"), 3))
    grams = spark.read.parquet(f"{path}/names").select("pos", F.explode(runs).alias("gram"))
    chunks = grams.groupBy("gram", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    chunks.repartitionByRange("gram", "chunk").sortWithinPartitions("gram", "chunk").write.parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.sum(F.size("positions")).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return open_name_index(spark, path)


def open_name_index(spark: SparkSession, path: str) -> NameIndex:
    return NameIndex(*[spark.read.parquet(f"{path}/{t}") for t in _TABLES])


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lower(F.trim("query")).alias("q")).filter(F.length("q") >= LEAST).withColumn("sn", parse_set_number(F.col("q")))


def _by_number(asked: DataFrame, index: NameIndex) -> DataFrame:
    """The items with exactly the set and number that a query names, one row per id."""
    wanted = asked.filter("sn is not null").select("query_id", number_key(F.col("sn.code"), F.col("sn.number")).alias("number_key"))
    rows = wanted.join(index.names.select("pos", "scryfall_id", "lang", "number_key"), "number_key")
    first = rows.groupBy("query_id", "scryfall_id").agg(F.min_by(F.struct("pos", "lang"), "pos").alias("r")).select("query_id", "scryfall_id", "r.*")
    return first.select("query_id", "scryfall_id", "pos", F.when(F.coalesce("lang", F.lit("en")) == "en", -2).otherwise(-1).alias("match"), F.lit(None).cast("long").alias("sorted"))


def _by_name(asked: DataFrame, index: NameIndex) -> DataFrame:
    """The rows whose name holds the query: those of its rarest run of three characters (of two, where it has no more) are
    fetched by position and looked at. A query with a run that no name has finds nothing."""
    wanted = asked.select("query_id", "q", F.explode(F.when(F.length("q") > 2, _grams(F.col("q"), 3)).otherwise(F.array("q"))).alias("gram"))
    often = wanted.join(index.counts, "gram", "left")
    rarest = often.groupBy("query_id", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    # What is looked at next is far more than these few rows, so they are dealt to all tasks, one query's chunks too.
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rarest.join(index.postings, "gram").select("query_id", "q", "chunk", "positions").repartition(n, "query_id", "chunk")
    hits = lists.select("query_id", "q", F.explode("positions").alias("pos"))
    named = hits.join(index.names.select("pos", "scryfall_id", "lower", "sorted"), "pos").filter(F.contains("lower", F.col("q")))
    return named.select("query_id", "scryfall_id", "pos", search_rank(F.col("lower"), F.col("q")).alias("match"), "sorted")


def _found(queries: DataFrame, index: NameIndex) -> DataFrame:
    asked = _asked(queries)
    number = _by_number(asked, index)
    # Only queries that name a set and number can have found a row by these already; hits of the others aren't compared.
    coded = _by_name(asked.filter("sn is not null"), index).join(number.select("query_id", "scryfall_id"), ["query_id", "scryfall_id"], "left_anti")
    return number.unionByName(coded).unionByName(_by_name(asked.filter("sn is null"), index))


def _texts(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with their text as it is looked for, and each different text once, which stands for its queries."""
    asked = queries.select("query_id", F.lower(F.trim("query")).alias("q")).filter(F.length("q") >= LEAST).distinct()
    return asked, asked.select(F.col("q").alias("query_id"), F.col("q").alias("query")).distinct()


def search_names(queries: DataFrame, index: NameIndex, limit: int = LIMIT) -> DataFrame:
    """queries (query_id, query) over a stored index.

    First the items with exactly the set and number that the query names, one row per id: English or without a language
    first, else in catalogue order.  Then rows whose name holds the query and whose id isn't among the first; by rank,
    name, set and number.  The best ``limit`` of each query, whose other columns are fetched then.  Queries that ask for the
    same are looked for once.
    """
    asked, texts = _texts(queries)
    order = Window.partitionBy("query_id").orderBy("match", F.asc_nulls_first("sorted"), "pos")
    best = _found(texts, index).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    columns = ("place", "pos", "scryfall_id", "name", "set_code", "collector_number")
    whole = best.select("query_id", "place", "pos").join(index.names.select(*columns[1:]), "pos")
    each = whole.groupBy(F.col("query_id").alias("q")).agg(F.collect_list(F.struct(*columns)).alias("found"))  # limit rows at most
    return asked.join(each, "q").select("query_id", F.inline("found"))


def count_found(queries: DataFrame, index: NameIndex) -> DataFrame:
    """How many rows each query finds by number and by name together, without putting them in order."""
    asked, texts = _texts(queries)
    counts = _found(texts, index).groupBy(F.col("query_id").alias("q")).agg(F.count("*").alias("n"))
    return asked.join(counts, "q").select("query_id", "n")


def name_search(queries: DataFrame, catalog: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``search_names`` over an index that is made for these queries alone."""
    spark = catalog.sparkSession
    path = new_path(spark, "names")
    index = build_name_index(catalog, path)
    passing(spark, path)
    return search_names(queries, index, limit)


def public_fields(rows: DataFrame) -> DataFrame:
    return rows.select("scryfall_id", "name", "set_code", "collector_number", "set_name")
