"""Streams: scans folded into a collection, and query vectors identified as they come."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardloom.operators.vectors import identify, topk


def fold_scans(scans: DataFrame, late: str | None = None) -> DataFrame:
    """scans (card_id, scryfall_id, foil, count, created_at, ord), batch or stream, to one row per (scryfall_id, foil): the
    summed count, the newest date, and the first arrived row's id. A repeated card_id counts once. Sum, maximum and the
    least ord don't depend on the order of arrival, so a stream ends at what a batch gives.

    A stream remembers every id, unless ``late`` says how long after a scan its repetition can come: ids are then forgotten
    once the newest created_at is that much later. The folded rows themselves are the collection, and all stay."""
    once = scans.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["card_id"]) if late else scans.dropDuplicates(["card_id"])
    return once.groupBy("scryfall_id", "foil").agg(F.sum("count").alias("count"), F.max("created_at").alias("created_at"), F.min_by("card_id", "ord").alias("card_id"))


def stream_scans(scans: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Runs ``fold_scans`` on what is there, giving ``write`` each batch of changed rows."""
    return fold_scans(scans, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def stream_identify(queries: DataFrame, index: DataFrame, k: int, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Identifies each batch of query vectors against a static index, as ``identify`` does."""

    def batch(rows: DataFrame, number: int) -> None:
        write(identify(rows, topk(rows, index, k)), number)

    return queries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


#: How long a scan's id is remembered after it last came, in milliseconds.
REMEMBERED = 24 * 3600 * 1000
HELD = "scryfall_id string, foil boolean, count long, created_at timestamp, card_id string, ord long"


#: What a session needs for state of several columns; and no batches without scans, which a clock brings forth without end.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = {k: spark.conf.get(k) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Into how many parts a key's ids go, once it has counted so many copies.
PARTS = ((0, 1), (256, 64), (16_384, 4096))


class HeldScans(StatefulProcessor):
    """The collection as state: for each (scryfall_id, foil) its row, and the ids of scans that it has counted, each of which
    goes some time after it last came. Puts out the rows that a batch changed, and those alone.

    Each call to the state is a message to the JVM, so ids are held by parts, with the times when they came: a key of few
    scans has one part, and is asked for its ids once a batch; one of many has so many that a scan reads few of them."""

    def __init__(self, remembered: int = REMEMBERED):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "count long, created_at timestamp, card_id string, ord long")
        self.ids = handle.getMapState("ids", "parts int, part int", "ids array<string>, came array<long>", self.remembered)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        """The row of the collection that was held before; its own id is counted already."""
        for r in initialState.itertuples(index=False):
            self.row.update((int(r.count_), r.created_at, r.card_id, int(r.ord)))
            self._new([r.card_id], int(r.count_), timerValues.getCurrentProcessingTimeInMs())

    def _new(self, ids: list[str], count: int, now: int) -> set[str]:
        """Those of the ids that aren't remembered; all are from now on, in as many parts as that count of copies takes."""
        new = set(ids)
        sizes = [parts for least, parts in PARTS if least <= count]
        for parts in sizes:
            by_part: dict[int, list[str]] = {}
            for x in ids:
                by_part.setdefault(zlib.crc32(x.encode()) % parts, []).append(x)
            for part, own in by_part.items():
                held = self.ids.getValue((parts, part))
                there = {x: at for x, at in zip(*held, strict=True) if now - at < self.remembered} if held else {}
                new -= there.keys()
                if parts == sizes[-1]:
                    there |= dict.fromkeys(own, now)
                    self.ids.updateValue((parts, part), (list(there), list(there.values())))
        return new

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = before = self.row.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            scans: dict[str, tuple] = {}
            for scan in sorted(zip(frame["ord"], frame["card_id"], frame["count_"], frame["created_at"], strict=True), key=lambda x: x[0]):
                scans.setdefault(scan[1], scan)
            count = sum(int(x[2]) for x in scans.values()) + (held[0] if held else 0)
            new = self._new(list(scans), count, now)
            fresh = [x for card_id, x in scans.items() if card_id in new]
            if not fresh:
                continue
            (place, first, *_), newest = fresh[0], max(x[3] for x in fresh)
            count = sum(int(x[2]) for x in fresh)
            if held is None:
                held = (count, newest, first, int(place))
            else:
                mine = (first, int(place)) if place < held[3] else (held[2], held[3])
                held = (held[0] + count, max(held[1], newest), *mine)
        if held is not None and held != before:
            self.row.update(held)
            yield pd.DataFrame({"scryfall_id": [key[0]], "foil": [key[1]], "count": [held[0]], "created_at": [held[1]], "card_id": [held[2]], "ord": [held[3]]})

    def close(self) -> None:
        pass


def held_scans(scans: DataFrame, library: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """A stream of scans (card_id, scryfall_id, foil, count, created_at, ord) folded into a collection that is held already
    (the same columns, one row per (scryfall_id, foil)): rows that changed, as they change. A scan that comes again within
    ``remembered`` milliseconds counts once. Scans without an item are left out. The session's state store must be one that
    keeps several columns of state, as within ``rocksdb_state``."""
    columns = ["card_id", "scryfall_id", "foil", F.col("count").cast("long").alias("count_"), "created_at", F.col("ord").cast("long").alias("ord")]
    state = library.filter("scryfall_id is not null").select(*columns).groupBy("scryfall_id", "foil")
    return scans.filter("scryfall_id is not null").select(*columns).groupBy("scryfall_id", "foil").transformWithStateInPandas(
        statefulProcessor=HeldScans(remembered), outputStructType=HELD, outputMode="Update", timeMode="ProcessingTime", initialState=state
    )
