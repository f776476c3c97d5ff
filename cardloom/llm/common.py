"""What the language-data operators share: the shared scratch folder, clean inputs, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lower-casing of the contracts: A-Z only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.  A folder
    of our own serves only where all tasks run on this machine; elsewhere executors would not see each other's files."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("cardloom.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("cardloom.shared.dir", base)
    return base.rstrip("/")


#: The folder of the step that is running, if there is one; see ``scratch``.
_STEP: ContextVar[str | None] = ContextVar("step", default=None)
#: Where the tables that ``materialize`` has returned lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{_STEP.get() or shared_dir(spark)}/cardloom-{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def passing(spark: SparkSession, path: str) -> str:
    """Marks a folder that is there as one that goes when the application ends, if it isn't deleted before."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What is materialized inside goes when the block ends: its result must have been written elsewhere by then."""
    path = scratch_path(spark, name)
    token = _STEP.set(path)
    try:
        yield
    finally:
        _STEP.reset(token)
        delete(spark, path)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder (or to ``path``) and reads it back: cuts lineage, and survives lost executors. The
    table goes with its ``scratch`` block, with ``discard``, or else when the application ends."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(passing(spark, path))
    _PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing unwritten still reads."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path:
            delete(table.sparkSession, path)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and what else is asked for; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: Column, text: Column, *more: Column) -> Column:
    """What tells rows apart: doc_id and 128 bits of the text (null: empty) and of other columns. No full hash of texts
    that only need to be found again."""
    text = F.coalesce(text, F.lit(""))
    parts = [x for c in more for x in (c.isNull(), c.cast("string"))]
    return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.xxhash64(text, *parts), F.xxhash64(F.lit(7), text, *parts))


def flagged(docs: DataFrame, key: Column, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` as (row, key) in two parts: rows whose key surely isn't in the column ``key`` of ``found``, and the others.
    Only the second part needs to be shuffled with its texts. Column names of ``docs`` can't clash with any of ours."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    marked = with_filter(packed, bit_filter(found, "key"), "key", flag="_in")
    return marked.filter(~F.col("_in")).select("row", "key"), marked.filter("_in").select("row", "key")


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in the column ``key`` of ``gone``. Texts of rows that stay aren't shuffled, but
    for the few that the filter of fixed size can't tell apart."""
    clear, others = flagged(docs, key, gone)
    return clear.select("row.*").unionByName(others.join(gone.select("key"), "key", "left_anti").select("row.*"))


def lower_ascii(column) -> "F.Column":
    return F.translate(column, UPPER, LOWER)


def release() -> None:
    """Gives the memory that a worker has freed back to the system: workers live on, and their next task is of another kind."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def text_views(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """A batch's texts as one byte array and the n + 1 places where they begin and end, without copies. Nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    base = int(places[0]) if len(places) else 0
    return raw[base : int(places[-1])] if len(places) else raw[:0], places - base


#: Bits of a filter: 2 MB, broadcast whatever the input's size.
FILTER_BITS = 1 << 24


def bit_filter(keys: DataFrame, *key, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the hashed keys, in rows of 4 KB: at most ``bits`` / 32768 + 1 of them, which bounds a broadcast."""
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    return keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


def with_filter(df: DataFrame, held: DataFrame, *key, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds ``flag``: true for each row whose key is in the filter, and for a few others (all, once the filter is full)."""
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(bitmap, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    joined = df.withColumns({"_bit": bit, "_bucket": F.bitmap_bucket_number(place)}).join(F.broadcast(held.withColumnRenamed("bucket", "_bucket")), "_bucket", "left")
    hit = F.coalesce(byte.bitwiseAND(F.expr("int(shiftleft(1, int(_bit % 8)))")) != 0, F.lit(False))
    return joined.withColumn(flag, hit).drop("_bit", "_bucket", "bitmap")


def in_filter(keys: DataFrame, *key, bits: int = FILTER_BITS) -> Column:
    """For rows of any table: whether their key is among ``keys`` (and for a few others). The filter, 2 MB whatever its
    number of keys, is one value that the plan asks for, so no row is joined."""
    rows = bit_filter(keys, *key, bits=bits).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bitmap"))).alias("of"))
    held = rows.select(F.transform(F.sequence(F.lit(0), F.lit(bits // 32768)), lambda b: F.element_at("of", b)).alias("rows"))
    place = F.pmod(F.xxhash64(*key), F.lit(bits))
    bit = F.bitmap_bit_position(place)
    byte = F.substring(F.get(held.scalar(), F.bitmap_bucket_number(place).cast("int")), F.floor(bit / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(value / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
