"""Streams over events, which stand for scans; each query runs what is there and returns where it ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.plans import tables as T
from cardloom.plans.registry import query
from cardloom.sources.shared import new_path
from cardloom.streaming.scans import held_scans, rocksdb_state, stream_identify, stream_scans


def _stream(spark, rows, name):
    path = new_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("stream_scans", "SELECT CAST(user_id AS VARCHAR) AS scryfall_id, event_type = 'click' AS foil, count(*) AS count, max(ts) AS created_at, arg_min(CAST(event_id AS VARCHAR), event_id) AS card_id FROM events GROUP BY 1, 2")
def stream_scans_query(spark, sf):
    """Every event is sent twice; the second counts nothing."""
    rows = T.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("card_id"), F.col("user_id").cast("string").alias("scryfall_id"), (F.col("event_type") == "click").alias("foil"), F.lit(1).cast("long").alias("count"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("ord"),
    )
    out = new_path(spark, "folded")
    stream = stream_scans(_stream(spark, rows.unionByName(rows), "scans"), lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out), new_path(spark, "stream"))
    stream.awaitTermination()
    last = spark.read.parquet(out)
    names = [c for c in last.columns if c not in ("scryfall_id", "foil", "_batch")]
    return last.groupBy("scryfall_id", "foil").agg(F.max_by(F.struct(*names), "_batch").alias("r")).select("scryfall_id", "foil", "r.*")


@query("stream_identify", "WITH " + T.VECTORS_SQL + " SELECT query_id, CASE WHEN max(score) >= 0.7 THEN 'CONFIDENT' WHEN max(score) >= 0.4 THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS confidence FROM hits WHERE mode = 'half' AND rank <= 5 GROUP BY query_id")
def stream_identify_query(spark, sf):
    queries = T.queries(spark, sf, "half").select("query_id", "embedding")
    out = new_path(spark, "identified")
    stream = stream_identify(_stream(spark, queries, "queries"), T.index(spark, sf), 5, lambda rows, n: rows.write.mode("append").parquet(out), new_path(spark, "stream"))
    stream.awaitTermination()
    return spark.read.parquet(out).select("query_id", "confidence")


FOLDED = """, h AS (SELECT u, f, count(*) AS count, max(ts) AS created_at, min(event_id) AS ord FROM e WHERE event_id % 3 = 0 GROUP BY u, f), n AS (SELECT u, f, count(*) AS count, max(ts) AS created_at, min(event_id) AS ord FROM e WHERE event_id % 3 <> 0 GROUP BY u, f)
SELECT u AS scryfall_id, f AS foil, coalesce(h.count, 0) + n.count AS count, greatest(coalesce(h.created_at, n.created_at), n.created_at) AS created_at, CAST(least(coalesce(h.ord, n.ord), n.ord) AS VARCHAR) AS card_id FROM n LEFT JOIN h USING (u, f)"""


@query("stream_held_scans", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type = 'click' AS f, ts, event_id FROM events)" + FOLDED)
def stream_held_scans(spark, sf):
    """Two thirds of the events, each sent twice, over a collection folded from the others: the last state of rows that
    changed."""
    rows = T.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("card_id"), F.col("user_id").cast("string").alias("scryfall_id"), (F.col("event_type") == "click").alias("foil"), F.lit(1).cast("long").alias("count"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("ord"),
    )
    first = rows.filter("ord % 3 = 0").groupBy("scryfall_id", "foil")
    library = first.agg(F.min_by("card_id", "ord").alias("card_id"), F.sum("count").alias("count"), F.max("created_at").alias("created_at"), F.min("ord").alias("ord"))
    new = rows.filter("ord % 3 <> 0")
    out = new_path(spark, "folded")
    with rocksdb_state(spark):
        changed = held_scans(_stream(spark, new.unionByName(new), "scans"), library)
        write = lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)
        changed.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "stream")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("scryfall_id", "foil").agg(F.max_by(F.struct("count", "created_at", "card_id"), "_batch").alias("r"))
    return last.select("scryfall_id", "foil", "r.*")
