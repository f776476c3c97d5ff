"""Language-model scores of documents: a subword lattice's marginal likelihood, beside a smoothed word unigram.

The pieces are an existing vocabulary's, and its scores (their ranks) the first estimate of their probabilities.  Under it
all segmentations of the training words are weighed, and expectation maximisation over the words' counts, to rest, makes a
unigram model of the corpus; the vocabulary's estimate stays as the prior, with the weight of ``PRIOR_COUNT`` pieces.  A
step is one pass over distinct words.  Without any (``steps=0``) the vocabulary's scores alone decide.  A document's
probability is that of all its words' segmentations and an end: pieces never cross words, so it is the product of the
words' marginals, and each distinct word's lattice is run once.

One scan cuts the texts into blocks of about ``BLOCK_BYTES`` and writes, per block, its distinct words with their training
counts, and per document the places and numbers of its words there.  Word counts of the whole corpus are one aggregation
over the blocks' words (which are far fewer than the documents'), their scores go back to the blocks by a join on the
word - a word has at most a row per block - and each block's documents are summed beside its words.  What is gathered
grows with the corpus; nothing but the piece table (of the vocabulary's size) goes to the driver.

Lower-casing is A-Z only. Null texts are empty: the end token alone. With no training documents every count is 0 and the
piece model is its prior. A null doc_id counts as training, as its crc32 is not known. Rows that repeat count and are scored
each. A very long text is a block of its own, beyond ``BLOCK_BYTES``, and one row there; a very long word is one lattice. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import documents, materialize, release, text_views
from cardloom.llm.lattice import expectation, log_probabilities, pieces
from cardloom.llm.words import LOWERED, slices, word_hashes, word_spans

BLOCK_BYTES = 4 << 20
FOLDS = 10
#: Tasks in which blocks meet their words' scores, at most.
MOST_TASKS = 100_000
#: Weight of the prior against the corpus' expected counts.
PRIOR_COUNT = 1000.0
#: Steps end where the words' log probability grows by no more than this share, or after so many.
REST, MOST_STEPS = 0.002, 12
_BLOCKS = "block long, place int, word string, n_train long, doc_id long, held_out boolean, n_tokens long, places binary, numbers binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as strings, copied from ``data`` at once."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    where = np.repeat(starts - offsets[:-1], sizes)
    where += np.arange(offsets[-1], dtype=np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[where].tobytes()))


def _block(number: int, ids: list, data: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    data = LOWERED[data]
    found = []
    for lo, hi in slices(places):  # small parts: the hashes' tables are as long as what is hashed at once
        at = int(places[lo])
        own = data[at : places[hi]]
        if len(own):
            starts, ends, of = word_spans(own, places[lo : hi + 1] - at)
            found.append((word_hashes(own, starts, ends), (starts + at).astype(np.int32), (ends + at).astype(np.int32), np.diff(of)))
        else:
            found.append((np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(hi - lo, np.int64)))
    hashes, starts, ends, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
    of = np.concatenate([[0], np.cumsum(sizes)])
    held = np.array([is_held_out(d) for d in ids], bool)
    if len(starts):
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        del hashes, found
        inverse = inverse.astype(np.int32)
        training = ~np.repeat(held, np.diff(of))
        n_train = np.bincount(inverse[training], minlength=len(first))
        n = len(first)
        words = [pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), _gathered(data, starts[first], ends[first]), pa.array(n_train)]
        blank = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays(words + blank, _NAMES)
    places_, numbers = [], []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        own, n = np.unique(inverse[a:b], return_counts=True) if b > a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        step = np.diff(own, prepend=0).astype("<u4")
        places_.append(step.view(np.uint8).reshape(-1, 4).T[:3].tobytes())  # the low bytes, then the middle, then the high
        numbers.append(n.astype(np.uint8).tobytes() if len(n) == 0 or n.max() < 256 else n.astype("<u4").tobytes())
    m = len(ids)
    blank = [pa.nulls(m, t) for t in (pa.int32(), pa.string(), pa.int64())]
    docs = [pa.array(ids, pa.int64()), pa.array(held), pa.array(np.diff(of) + 1), pa.array(places_, pa.binary()), pa.array(numbers, pa.binary())]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), *blank, *docs], _NAMES)


_NAMES = [x.split()[0] for x in _BLOCKS.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, parts, size, ends = [], [], 0, [0]
    for batch in batches:
        data, places = text_views(batch)
        for lo, hi in slices(places, BLOCK_BYTES):
            ids += batch.column(0).slice(lo, hi - lo).to_pylist()
            parts.append(data[places[lo] : places[hi]].copy())
            ends += (places[lo + 1 : hi + 1] - places[lo] + size).tolist()
            size = ends[-1]
            if size >= BLOCK_BYTES:
                yield from _block(number, ids, np.concatenate(parts), np.array(ends))
                number, ids, parts, size, ends = number + 1, [], [], 0, [0]
    if ids:
        yield from _block(number, ids, np.concatenate(parts), np.array(ends))
    del ids, parts, ends
    release()


def _expectations(path: str, log_p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        total, likelihood = np.zeros(vocabulary.size), 0.0
        for batch in batches:
            counts, own = expectation(vocabulary, log_p, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            total += counts
            likelihood += own
        release()
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(total[there], likelihood))], ["piece", "expected"])

    return run


def piece_model(counts: DataFrame, n_documents: int, path: str, steps: int | None = None) -> tuple[np.ndarray, float]:
    """Log probabilities of the vocabulary's pieces and bytes, and of the end, from the training words' counts. ``steps`` of
    expectation maximisation, or as many as bring the words' log probability to rest; without one the counts only tell how
    often a document ends."""
    vocabulary = pieces(path)
    if steps == 0:
        words = counts.agg(F.sum("c")).first()[0] or 0
        ends = (n_documents + 1.0) / (n_documents + words + 1.0)
        return np.log(vocabulary.prior * (1 - ends)), math.log(ends)
    prior, ends = PRIOR_COUNT * vocabulary.prior, n_documents + 1.0
    log_p, total, before = np.log(vocabulary.prior), 0.0, -math.inf
    for step in range(MOST_STEPS if steps is None else steps):
        summed = counts.filter("c > 0").select("word", "c").mapInArrow(_expectations(path, log_p), "piece long, expected double")
        rows = summed.groupBy("piece").agg(F.sum("expected").alias("expected")).toPandas()  # as many rows as the vocabulary has pieces
        found = rows[rows["piece"] >= 0]
        expected = prior.copy()
        expected[found["piece"].to_numpy(np.int64)] += found["expected"].to_numpy()
        likelihood = float(rows.loc[rows["piece"] < 0, "expected"].sum())
        if steps is None and step and likelihood - before <= REST * abs(likelihood):
            break  # the estimate that these words were weighed under is kept
        total = float(expected.sum())
        log_p, before = np.log(expected / total), likelihood
    return log_p + math.log(total / (total + ends)), math.log(ends / (total + ends))


def _word_scores(path: str, log_p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            score = log_probabilities(vocabulary, log_p, batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["word", "c", "lattice"])
        release()

    return run


def _summed(low: float, training: int, end_score: float):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        size = (pc.max(words.column("place")).as_py() or 0) + 1 if len(words) else 0
        values = np.zeros((3, size))
        if size:
            where, c = words.column("place").to_numpy(), words.column("c").to_numpy()
            values[0, where], values[1, where], values[2, where] = c > 0, np.log10((c + 0.1) / low), words.column("lattice").to_numpy()
        out = []
        for places, numbers in zip(docs.column("places").to_pylist(), docs.column("numbers").to_pylist(), strict=True):
            m = len(places) // 3
            bytes_ = np.zeros((m, 4), np.uint8)
            bytes_[:, :3] = np.frombuffer(places, np.uint8).reshape(3, m).T
            own = np.cumsum(bytes_.view("<u4").ravel().astype(np.int64))
            n = np.frombuffer(numbers, np.uint8 if len(numbers) == m else "<u4")
            out.append(values[:, own] @ n if m else np.zeros(3))
        sums = np.array(out).reshape(-1, 3)
        end = math.log10((training + 0.1) / low)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": docs.column("n_tokens"),
                "n_known": pa.array(np.rint(sums[:, 0]).astype(np.int64) + int(training > 0)),
                "base_score": pa.array(sums[:, 1] + end), "score": pa.array(sums[:, 2] + end_score),
            }
        )

    return run


def score_documents(docs: DataFrame, piece_model_path: str, steps: int | None = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10); with so many steps, or (None) as many as
    bring the model to rest."""
    blocks = materialize(documents(docs).mapInArrow(_blocks, _BLOCKS), "blocks")
    words = blocks.filter(F.col("word").isNotNull()).select("block", "place", "word", "n_train")
    own = blocks.filter(F.col("n_tokens").isNotNull()).select("block", "doc_id", "held_out", "n_tokens", "places", "numbers")
    counts = materialize(words.groupBy("word").agg(F.sum("n_train").alias("c")), "counts")
    total = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    training = own.filter("not held_out").count()
    n, v = (total[0] or 0) + training, (total[1] or 0) + (training > 0)
    log_p, log_end = piece_model(counts, training, piece_model_path, steps)
    scored = counts.mapInArrow(_word_scores(piece_model_path, log_p), "word string, c long, lattice double")
    known = words.select(F.col("block").alias("in_block"), "place", "word").join(scored, "word").select("in_block", "place", "c", "lattice")
    # Groups can't be split: a task for each block, as far as tasks go.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, own.select("block").distinct().count()))
    grouped = own.repartition(tasks, "block").groupBy("block").cogroup(known.repartition(tasks, "in_block").groupBy("in_block"))
    summed = grouped.applyInArrow(_summed(n + 0.1 * (v + 1), training, log_end / math.log(10)), SCORES)
    return summed.withColumn("train_tokens", F.lit(n).cast("long"))


def perplexity(scores: pd.DataFrame) -> float:
    """Of a set of scored documents, per token."""
    return 10 ** (-scores["score"].sum() / scores["n_tokens"].sum())
