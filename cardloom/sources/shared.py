"""Tables in the folder that driver and executors share, for as long as a step needs them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: The folder of the step that is running, if there is one; see ``scratch``.
_STEP: ContextVar[str | None] = ContextVar("step", default=None)
#: Where the tables that ``kept`` has returned lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or what ``setCheckpointDir`` named. A folder of this session's own serves only where all
    tasks run on this machine; elsewhere executors would not see each other's files."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("cardloom.shared.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cardloom-")
        spark.conf.set("cardloom.shared.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{_STEP.get() or shared_dir(spark)}/cardloom-{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    place, store = _place(spark, path)
    store.delete(place, True)


#: Folders of tables that are made once per application, by what they were made of.
_MADE: dict[tuple, str] = {}


def made_once(spark: SparkSession, name: str, key: tuple, make: Callable[[str], object]) -> str:
    """The folder that ``make`` has filled for this key in this application; it is filled again if it is gone."""
    key = (spark.sparkContext.applicationId, name, *key)
    path = _MADE.get(key)
    if path is not None:
        place, store = _place(spark, path)
        if store.exists(place):
            return path
    path = f"{shared_dir(spark)}/cardloom-{name}-{uuid.uuid4().hex}"
    make(path)
    _MADE[key] = passing(spark, path)
    return path


def passing(spark: SparkSession, path: str) -> str:
    """Marks a folder that is there as one that goes when the application ends, if not before."""
    place, store = _place(spark, path)
    store.deleteOnExit(place)
    return path


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What is kept inside goes when the block ends: results must have been written elsewhere by then."""
    path = new_path(spark, name)
    token = _STEP.set(path)
    try:
        yield
    finally:
        _STEP.reset(token)
        delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: what is used twice is computed once, and is the same twice. The
    copy goes with its ``scratch`` block, with ``discard``, or else when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(passing(spark, path))
    _PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing unwritten still reads."""
    for table in tables:
        path = _PLACES.pop(table, None)
        if path:
            delete(table.sparkSession, path)
