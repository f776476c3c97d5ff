"""Import of collection files: match each row to a printing, collapse per key, fold into the collection, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import new_card_id, placeholder_key
from cardloom.operators.catalog import with_printing
from cardloom.operators.library import FIELDS, upsert_add, upsert_set
from cardloom.sources.snapshots import Snapshot, read_snapshot, snapshot, write_snapshot

REPORTED = 50


def match_import(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows (line, count, name, set_code, collector_number, foil, lang, modified_at) with the best printing's id and name;
    null where there is none."""
    return with_printing(rows, catalog).withColumns({"scryfall_id": F.col("best.scryfall_id"), "catalog_name": F.col("best.name")}).drop("best")


def _cards(each: DataFrame) -> DataFrame:
    card = new_card_id(F.lit("import"), F.col("key"))
    return each.select(
        card.alias("card_id"), "scryfall_id", "name", "set_code", "collector_number", "foil", "count", F.col("modified_at").alias("created_at"),
        F.col("modified_at").alias("updated_at"), F.col("line").alias("ord"), F.lit(None).cast("string").alias("photo"),
    )


def collect_import(matched: DataFrame) -> DataFrame:
    """Library rows: per printing and foil (or, unmatched, per name, set, number and foil) the summed count, the newest
    date, and all else of the first line."""
    known = F.concat(F.col("scryfall_id"), F.lit("|"), F.col("foil").cast("string"))
    key = F.coalesce(known, F.concat(F.lit("?"), placeholder_key(F.col("name"), F.col("set_code"), F.col("collector_number"), F.col("foil"))))
    fields = ("scryfall_id", "set_code", "collector_number", "foil", "line")
    first = F.min_by(F.struct(F.coalesce("catalog_name", "name").alias("name"), *fields), "line")
    each = matched.withColumn("key", key).groupBy("key").agg(F.sum("count").alias("count"), F.max("modified_at").alias("modified_at"), first.alias("f"))
    return _cards(each.select("key", "count", "modified_at", "f.*"))


def upsert_placeholders(library: DataFrame, cards: DataFrame, mode: str = "set") -> DataFrame:
    """Cards without a printing against held ones of the same name, set, number and foil; of several the oldest is used.
    Its date becomes the card's only if the count grew. Others are inserted."""
    key = placeholder_key(F.col("name"), F.col("set_code"), F.col("collector_number"), F.col("foil"))
    held = library.filter("scryfall_id is null").withColumn("_key", key)
    first = held.groupBy("_key").agg(F.min_by("card_id", F.struct("created_at", "ord")).alias("_target"))
    new = cards.withColumn("_key", key).join(first, "_key", "left")
    hit = new.filter("_target is not null").select(F.col("_target").alias("card_id"), F.col("count").alias("n_count"), F.col("created_at").alias("n_at"), F.col("updated_at").alias("n_up"))
    rows = library.filter("scryfall_id is null").join(hit, "card_id", "left")
    count = F.col("count") + F.col("n_count") if mode == "add" else F.col("n_count")
    grew = F.col("n_count").isNotNull() & (count > F.col("count"))
    pick = {"count": F.when(F.col("n_count").isNotNull(), count).otherwise(F.col("count")), "created_at": F.when(grew, F.coalesce("n_at", "created_at")).otherwise(F.col("created_at")), "updated_at": F.when(F.col("n_count").isNotNull() & (count != F.col("count")), F.coalesce("n_up", "updated_at")).otherwise(F.col("updated_at"))}
    kept = rows.select(*[pick.get(c, F.col(c)).alias(c) for c in FIELDS])
    untouched = library.filter("scryfall_id is not null").select(*FIELDS)
    return untouched.unionByName(kept).unionByName(new.filter("_target is null").select(*FIELDS))


def import_collection(library: DataFrame, rows: DataFrame, catalog: DataFrame, mode: str = "set") -> DataFrame:
    """The next library; ``set`` makes counts the file's, ``add`` adds them. Writing its snapshot is one step, so all rows
    or none are imported."""
    cards = collect_import(match_import(rows, catalog))
    known, rest = cards.filter("scryfall_id is not null"), cards.filter("scryfall_id is null")
    folded = upsert_add(library, known).drop("merged") if mode == "add" else upsert_set(library, known)
    return upsert_placeholders(folded, rest, mode)


def import_snapshot(spark: SparkSession, path: str, rows: DataFrame, catalog: DataFrame, mode: str = "set") -> Snapshot:
    """``import_collection`` over the collection that is in force in ``path``, put in force as its next snapshot: all rows or
    none, and only if no other writer came between."""
    held = snapshot(spark, path)
    if held is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return write_snapshot(import_collection(read_snapshot(spark, path, held.number), rows, catalog, mode), path, held.number)


def distinct_unmatched(matched: DataFrame) -> DataFrame:
    """Names without a printing, with their first line."""
    return matched.filter("scryfall_id is null").groupBy("name").agg(F.min("line").alias("line"))


def import_report(library: DataFrame, rows: DataFrame, catalog: DataFrame, most: int = REPORTED) -> DataFrame:
    """One row: lines, printings and placeholders added and updated, lines unmatched, and the first unmatched names."""
    matched = match_import(rows, catalog)
    cards = collect_import(matched)
    held = library.select("scryfall_id", "foil", F.lit(True).alias("_held")).filter("scryfall_id is not null").distinct()
    key = lambda: placeholder_key(F.col("name"), F.col("set_code"), F.col("collector_number"), F.col("foil"))
    old = library.filter("scryfall_id is null").select(key().alias("_k")).distinct().withColumn("_old", F.lit(True))
    each = cards.join(held, ["scryfall_id", "foil"], "left").withColumn("_k", F.when(F.col("scryfall_id").isNull(), key())).join(old, "_k", "left")
    there = F.coalesce("_held", "_old", F.lit(False))
    names = F.slice(F.array_sort(F.collect_list(F.struct("line", "name"))), 1, most)
    first = distinct_unmatched(matched).orderBy("line").limit(most).agg(F.transform(names, lambda x: x["name"]).alias("unmatched_names"))
    counts = matched.agg(F.count("*").alias("rows"), F.count_if(F.col("scryfall_id").isNull()).alias("unmatched"))
    return counts.join(F.broadcast(each.agg(F.count_if(~there).alias("added"), F.count_if(there).alias("updated")))).join(F.broadcast(first))
