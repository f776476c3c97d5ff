"""Snapshots of a table that are switched all or nothing.

Rows are written to a folder of their own first; a manifest with the snapshot's number, folder and count of rows comes
last, by a rename that fails where that number is taken.  Readers take the manifest with the largest number, so a writer
that stops half-way leaves the old snapshot in force, and of two writers that began from the same one the second fails.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Snapshot(NamedTuple):
    number: int
    data: str
    rows: int


class SnapshotConflict(Exception):
    """Another writer has put a snapshot in force since this one's was read."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return hadoop, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifests/{number:012d}.json"


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all snapshots that were put in force, ascending."""
    _, place, store = _files(spark, f"{path}/manifests")
    if not store.exists(place):
        return []
    names = [f.getPath().getName() for f in store.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> Snapshot | None:
    """The snapshot in force, or one before it by its number; None where there is none."""
    numbers = snapshots(spark, path)
    if not numbers or number is not None and number not in numbers:
        return None
    text = spark.read.text(_manifest(path, numbers[-1] if number is None else number), wholetext=True).first()[0]
    return Snapshot(**json.loads(text))


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    found = snapshot(spark, path, number)
    if found is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return spark.read.parquet(f"{path}/{found.data}")


def write_snapshot(df: DataFrame, path: str, based_on: int | None) -> Snapshot:
    """Puts ``df`` in force as the snapshot after ``based_on`` (None: the first). Where that isn't the one in force any more,
    nothing changes and ``SnapshotConflict`` is raised."""
    spark = df.sparkSession
    data = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    try:
        # Counted in what was written; the switch comes after it.
        made = Snapshot((based_on or 0) + 1, data, spark.read.schema(df.schema).parquet(f"{path}/{data}").count())
        _switch(spark, path, made, based_on)
    except BaseException:
        _, place, store = _files(spark, f"{path}/{data}")
        store.delete(place, True)
        raise
    return made


def _switch(spark: SparkSession, path: str, made: Snapshot, based_on: int | None) -> None:
    hadoop, place, store = _files(spark, f"{path}/manifests")
    now = snapshots(spark, path)
    if (now[-1] if now else None) != based_on:
        raise SnapshotConflict(f"{path}: in force is {now[-1] if now else None}, not {based_on}")
    store.mkdirs(place)
    draft = hadoop.Path(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    try:
        out.write(bytearray(json.dumps(made._asdict()).encode()))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = getattr(hadoop.Options.Rename, "NONE")
    try:
        context.rename(draft, hadoop.Path(_manifest(path, made.number)), options)
    except Exception as e:  # the name is taken: another writer was first
        store.delete(draft, False)
        if made.number in snapshots(spark, path):
            raise SnapshotConflict(f"{path}: snapshot {made.number} was put in force by another writer") from e
        raise


def forget_snapshots(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all but the newest ``keep`` (one at least) and their rows, manifests first; returns their numbers."""
    gone = snapshots(spark, path)[: -max(1, keep)]
    for number in gone:
        old = snapshot(spark, path, number)
        for name in (_manifest(path, number), f"{path}/{old.data}"):
            _, place, store = _files(spark, name)
            store.delete(place, True)
    return gone
