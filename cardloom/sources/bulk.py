"""Bulk records as JSON, catalogue tables and index snapshots as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators.catalog import CARD

#: Column names that mean the same, the first that exists being taken; whether a column is required.
ALIASES = {
    "scryfall_id": (("scryfall_id", "id"), True), "name": (("name",), True), "set_code": (("set_code", "set"), True), "collector_number": (("collector_number",), True),
    "artist": (("artist",), False), "type_line": (("type_line",), False), "rarity": (("rarity",), False), "set_name": (("set_name",), False), "colors": (("colors",), False),
    "mana_value": (("mana_value", "cmc"), False), "released_at": (("released_at",), False), "lang": (("lang",), False), "filename": (("filename",), False),
}


def scan_bulk_cards(spark: SparkSession, path: str, legacy: bool = False, partitions: int | None = None) -> DataFrame:
    """One record per line (blank lines skipped), or one array (``legacy``). Compressed files can't be split: give a number
    of partitions to spread what follows."""
    reader = spark.read.schema(CARD)
    rows = (reader.option("multiLine", True) if legacy else reader).json(path)
    return rows.repartition(partitions) if partitions else rows


def latest_path(spark: SparkSession, folder: str, pattern: str) -> str:
    """The last file by name; none is an error."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")
    last = names.agg(F.max("path")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return last


def scan_latest_bulk(spark: SparkSession, folder: str, pattern: str = "*.json*") -> DataFrame:
    """The last file by name, or all files of its folder where it lies in one below ``folder``."""
    last = latest_path(spark, folder, pattern)
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toUri().getPath()
    parent = last.rsplit("/", 1)[0]
    if path(parent).toUri().getPath() == root:
        return scan_bulk_cards(spark, last)
    return spark.read.schema(CARD).option("pathGlobFilter", pattern).json(parent)


def scan_card_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Only the columns needed, under their first name that exists; a missing required one raises, a missing optional one is
    null; empty artists and filenames and numbers that aren't finite are null."""
    rows = spark.read.parquet(path)
    picked = []
    for name, (aliases, required) in ALIASES.items():
        found = next((a for a in aliases if a in rows.columns), None)
        if found is None and required:
            raise ValueError(f"{path} has no column {' or '.join(aliases)}")
        kind = "double" if name == "mana_value" else "string"
        value = F.col(found).cast(kind) if found else F.lit(None).cast(kind)
        if name in ("artist", "filename"):
            value = F.nullif(value, F.lit(""))
        if name == "mana_value":
            value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        picked.append(value.alias(name))
    more = ["pos"] if "pos" in rows.columns else []
    return rows.select(*more, *picked)


def write_card_database(faces: DataFrame, path: str) -> None:
    faces.write.mode("overwrite").parquet(path)


def save_snapshot(index: DataFrame, path: str) -> None:
    """Positions, vectors and metadata in one table: their numbers can't differ."""
    index.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Positions must be 0 to n - 1 and all vectors of one size; checked in one pass over those columns."""
    index = spark.read.parquet(path)
    n, lo, hi, low, high = index.agg(F.count("*"), F.min("pos"), F.max("pos"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if n and (lo != 0 or hi != n - 1 or low != high or dim is not None and low != dim):
        raise ValueError(f"{path}: {n} rows, positions {lo} to {hi}, vectors of {low} to {high}")
    return index
