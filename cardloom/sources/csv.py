"""Collection files: quoted CSV in, two layouts out, evaluation manifests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import format_timestamp, language_code, parse_timestamp

# Headings of collection files and of the manifest.
REQUIRED = ("name", "edition", "collector number")
FULL = ("card_id", "scryfall_id", "name", "set_code", "collector_number", "foil", "count", "created_at", "updated_at", "artist", "rarity", "type_line", "has_photo")
#: The collection layout: heading, and what stands there.
LAYOUT = ("Count", "Tradelist Count", "Name", "Edition", "Condition", "Language", "Foil", "Tags", "Last Modified", "Collector Number", "Alter", "Proxy", "Purchase Price")
MANIFEST = (
    "filename string, category string, name string, set_code string, collector_number string, frame string, border_color string, full_art boolean, layout string, "
    "frame_effects string, rarity string, face_index int, gt_corners string"
)


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields with doubled quotes and line ends inside, a byte order mark, either line end, blank lines skipped; all
    columns are text."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")


def scan_moxfield_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Typed rows (line, count, name, set_code, collector_number, foil, lang, modified_at) with an ``error`` column; with
    ``strict`` an error raises as its row is read. Missing headings raise at once."""
    raw = scan_csv(spark, path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if lacking := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"{path} lacks {', '.join(lacking)}")
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c in raw.columns else F.lit("")
    count = F.when(text("count") == "", F.lit(1.0)).otherwise(text("count").try_cast("double"))
    whole = F.when((count == F.floor(count)) & count.between(1, 9999), count.cast("long"))
    error = F.when(whole.isNull(), F.concat(F.lit("bad count: "), text("count"))).when(text("name") == "", "no name")
    rows = raw.select(
        F.monotonically_increasing_id().alias("line"), whole.alias("count"), text("name").alias("name"), F.lower(text("edition")).alias("set_code"), text("collector number").alias("collector_number"),
        (text("foil") != "").alias("foil"), language_code(text("language")).alias("lang"), parse_timestamp(text("last modified")).alias("modified_at"), error.alias("error"),
    )
    return rows.withColumn("count", F.when(F.col("error").isNull(), F.col("count")).otherwise(F.raise_error(F.col("error")).cast("long"))) if strict else rows


def full_rows(cards: DataFrame) -> DataFrame:
    """Thirteen text columns in fixed order; null is empty, flags lower-case."""
    return cards.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FULL])


def export_full_csv(cards: DataFrame, path: str) -> None:
    full_rows(cards).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def exportable(cards: DataFrame) -> DataFrame:
    """Without placeholders that have no name."""
    return cards.filter(F.col("scryfall_id").isNotNull() | (F.col("name") != "Unknown"))


def named(cards: DataFrame, full_names: DataFrame) -> DataFrame:
    """Names joined over an item's faces, where known."""
    joined = cards.join(full_names.select("scryfall_id", "full_name"), "scryfall_id", "left")
    return joined.withColumn("name", F.coalesce("full_name", "name")).drop("full_name")


def moxfield_rows(cards: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = {
        "Count": text("count"), "Tradelist Count": text("count"), "Name": text("name"), "Edition": text("set_code"), "Condition": F.lit("Near Mint"), "Language": F.lit("English"),
        "Foil": F.when(F.col("foil"), "foil").otherwise(""), "Tags": F.lit(""), "Last Modified": format_timestamp(F.col("updated_at")), "Collector Number": text("collector_number"),
        "Alter": F.lit("False"), "Proxy": F.lit("False"), "Purchase Price": F.lit(""),
    }
    return exportable(cards).select(*[values[c].alias(c) for c in LAYOUT])


def export_moxfield_csv(cards: DataFrame, path: str) -> None:
    moxfield_rows(cards).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', emptyValue='""')


def scan_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True, quote='"', escape='"')


def write_results_csv(results: DataFrame, path: str) -> None:
    """One folder per mode."""
    results.write.mode("overwrite").partitionBy("mode").csv(path, header=True, quote='"', escape='"')
