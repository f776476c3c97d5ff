"""From documents to packed token sequences, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents.

In every stage rows are told apart by doc_id and text, so a null or repeated doc_id never takes another row along, other
columns pass through under their names, whatever these are, very long texts are whole, and an empty table gives an empty
one.  What else each stage does with nulls, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardloom.llm.common import discard, materialize, scratch, scratch_path
from cardloom.llm.exact_dedup import drop_exact_copies
from cardloom.llm.near_dedup import drop_near_duplicates
from cardloom.llm.packing import pack_documents
from cardloom.llm.pii import redact
from cardloom.llm.quality_rules import keep_good
from cardloom.llm.queries import CAPACITY, END_ID, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Rows that repeat have one verdict."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; in a tie, where rows repeat, all of them. Null texts are empty,
    a null doc_id is smaller than any other."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id; rows that repeat stay together. Rows
    without words, text or doc_id are linked with nothing and stay."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; of overlapping spans the first. Null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most CAPACITY ids, and the sequences that they lie in. Null texts are an end id alone; repeated rows are
    packed each."""
    return pack_documents(docs, tokenizer_path(), CAPACITY, END_ID)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Robust estimates, boosted trees and tokens are not SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")  # outside what is cleared
        with scratch(spark, name):  # what a stage writes on its way goes once its output is written
            docs, before = materialize(stage(spark, docs, sf_dir), name, path), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
