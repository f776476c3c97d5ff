"""Exact dedup by progressive refinement, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z.  A first pass sees each text's length in bytes and a hash of its
first characters: lengths that occur once are settled, then prefixes that occur once at their length.  Only what is left
is read in full: a filter of fixed size, broadcast, tells at the second scan which rows those are (and a few more, which
the full hash settles), so no text is shuffled.  Equal SHA-256 of the full normalised texts makes a group.

Counts are pre-aggregated before each shuffle, and the one join that meets a hot group - its rows with its one result -
has plain shuffles on both sides, which adaptive execution splits.

Null text counts as empty, and empty texts are one group.  Of a group the row with the largest doc_id stays; rows that
repeat a doc_id within a group all carry that keep_id, and all of them stay.  A null doc_id is smaller than any other; a
group of nulls alone keeps them.  A very long text is hashed where it is read, if another has its length and prefix, and is
never shuffled.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import FILTER_BITS, bit_filter, documents, lower_ascii, materialize, row_key, with_filter, without

PREFIX_CHARS = 64


def normalized(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def surviving_prefixes(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(length, prefix) that two rows or more have, after lengths that only one has are gone."""
    seen = _signatures(docs, prefix_chars).groupBy("length", "prefix").agg(F.count("*").alias("n"))
    lengths = seen.groupBy("length").agg(F.sum("n").alias("rows")).filter("rows > 1").select("length")
    return seen.filter("n > 1").join(lengths, "length", "left_semi").select("length", "prefix")


def _signatures(docs: DataFrame, prefix_chars: int, *more: str) -> DataFrame:
    return documents(docs).select(
        "doc_id", F.octet_length("text").alias("length"), F.xxhash64(lower_ascii(F.substring("text", 1, prefix_chars))).alias("prefix"), *more
    )


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept: one row per document. ``more`` are expressions over doc_id and text (null:
    empty) that are wanted beside them, computed in the second scan."""
    held = bit_filter(surviving_prefixes(docs, prefix_chars), "length", "prefix", bits=filter_bits)
    marked = with_filter(_signatures(docs, prefix_chars, "text"), held, "length", "prefix", flag="again", bits=filter_bits)
    full = F.when(F.col("again"), F.unhex(F.sha2(lower_ascii(F.col("text")), 256)))
    rows = materialize(marked.select("doc_id", full.alias("full_hash"), *[c.alias(n) for n, c in (more or {}).items()]), "hashes")
    groups = (
        rows.filter(F.col("full_hash").isNotNull()).groupBy("full_hash").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    )
    # Settled rows have no hash; their number spreads them over the join. A key of its own gives the right side its own
    # shuffle, so that a hot group's rows can be split.
    number = F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "utf-8")
    keyed = rows.withColumn("key", F.coalesce("full_hash", number))
    joined = keyed.join(groups.select(F.concat("full_hash", F.lit(b"")).alias("key"), "keep_id", "group_size"), "key", "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), *(more or {})
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Full hashes are read for surviving prefixes only, and only texts of
    rows that go are shuffled. Rows are told apart by doc_id and text."""
    gone = exact_groups(docs, more={"row": row_key(F.col("doc_id"), F.col("text"))}).filter("not kept").select(F.col("row").alias("key"))
    return without(docs, row_key(docs["doc_id"], docs["text"]), gone)
