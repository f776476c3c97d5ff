"""Language identification, word first: known words by their log frequency per language, others by ever shorter n-grams.

Learned from a sample of labelled rows, chosen by a hash of doc_id and text: at most about ``SAMPLE_DOCS`` of them and, where their
texts are long, as few as have about ``SAMPLE_BYTES`` of text together.  Every word and n-gram of the sample counts, however
rare.  The two bounds are what bounds the model, which the driver gathers and broadcasts: a letter of the sample begins one
n-gram of each order at most, and an entry has 22 bytes.  Of random letters the whole sample makes 5 million entries, 88 MB,
and takes the driver's Python to 0.7 GB while it sorts them; of prose, 0.2 million.  Counts are made in Spark.  Prediction is one scan.

Words are runs of letters (Unicode's categories L), lower-cased.  A word that no language knows backs off to the longest
order of character n-grams (of the word between boundary marks) of which any is known, and the known ones' mean log
frequency is the word's evidence.  A document's language has the largest sum over its words; the score is the softmax of
that sum, over at most ``EVIDENCE_WORDS`` words' worth, so that it doesn't saturate with length.

Null texts, texts without letters and texts met by an empty model are ``und`` with score 0; a null lang is never learned
from; a null doc_id counts as held out. Equal sums go to the smaller language name. A very long text is one row, of whose
words a worker keeps the evidence of ``CACHE_CELLS`` numbers at most. Rows that repeat get the same result. Empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import documents
from cardloom.llm.words import mix

SAMPLE_DOCS = 20_000
SAMPLE_BYTES = 4 << 20
ORDERS = (5, 4, 3, 2, 1)
KINDS = max(ORDERS) + 1
EVIDENCE_WORDS = 20
FOLDS = 5
ALPHA = 0.5
#: Numbers of evidence that a worker keeps for words it met, before it begins anew.
CACHE_CELLS = 1_000_000
#: Words that are taken at once.
PART = 4096
PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double"


_RUN = re.compile(r"[^\W\d_]+")


def letters(run: str) -> list[str]:
    """The words of a run of letters and of such numerals (fractions, superscripts, Roman ones) as are no decimal digits."""
    return [run] if run.isalpha() else ["".join(g) for alpha, g in groupby(run, str.isalpha) if alpha]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def grams(word: str, order: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


_RNG = np.random.Generator(np.random.PCG64(41))
_PLACE = _RNG.integers(0, 1 << 64, max(ORDERS), np.uint64) | np.uint64(1)
_KIND = _RNG.integers(0, 1 << 64, KINDS, np.uint64)


def word_keys(words: list[str]) -> np.ndarray:
    """A signed 64-bit hash of each."""
    return np.array([xxhash.xxh64_intdigest(w.encode(), 0) for w in words], np.uint64).view(np.int64)


class Grams:
    """The character n-grams of words between boundary marks, all at once."""

    def __init__(self, words: list[str]):
        self.of = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
        points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32)
        self.value = mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    def keys(self, order: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each n-gram, and the word that it is of; of all words, or of those whose flag is set."""
        n = len(self.of) - order + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.flatnonzero(self.of[:n] == self.of[order - 1 :]) if wanted is None else np.flatnonzero((self.of[:n] == self.of[order - 1 :]) & wanted[self.of[:n]])
        total = np.full(len(start), _KIND[order])
        for j in range(order):
            total += self.value[start + j] * _PLACE[j]
        return mix(total).view(np.int64), self.of[start]


_COUNTS = "lang string, kind int, key long, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, Counter[str]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            runs.setdefault(lang, Counter()).update(_RUN.findall(text.as_py().lower()))
    for lang, counter in runs.items():
        pairs = [(word, n) for run, n in counter.items() for word in letters(run)]
        for at in range(0, len(pairs), PART):
            words, n = [w for w, _ in pairs[at : at + PART]], np.array([n for _, n in pairs[at : at + PART]], np.int64)
            grams = Grams(words)
            for kind in (0, *ORDERS):
                keys, of = (word_keys(words), np.arange(len(words))) if kind == 0 else grams.keys(kind)
                found, where = np.unique(keys, return_inverse=True)
                each = np.bincount(where, weights=n[of], minlength=len(found)).astype(np.int64)
                m = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(np.full(m, kind, np.int32)), pa.array(found), pa.array(each)], ["lang", "kind", "key", "n"])


class Model:
    """Log frequencies per language of words (kind 0) and n-grams (their order): sorted keys, and for each the languages
    that have it."""

    def __init__(self, langs: list[str], lang: np.ndarray, kind: np.ndarray, key: np.ndarray, n: np.ndarray):
        """One entry per language (its place in ``langs``), kind and key, and its count."""
        self.langs = langs
        totals = np.zeros((KINDS, len(langs)))
        np.add.at(totals, (kind, lang), n)
        #: What a language gets for what it doesn't have, by kind.
        self.absent = np.log(ALPHA / (np.maximum(totals, 1) + 1))
        order = np.lexsort((lang, key))
        lang, kind, key, n = lang[order], kind[order], key[order], n[order]
        self.keys, at = np.unique(key, return_index=True)
        self.at = np.append(at, len(key)).astype(np.int64)
        self.lang = lang.astype(np.int16)
        self.value = np.log((n + ALPHA) / (totals[kind, lang] + 1)).astype(np.float32)

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their rows: a log frequency for each language."""
        where = np.searchsorted(self.keys, keys)
        known = np.flatnonzero(self.keys[np.minimum(where, len(self.keys) - 1)] == keys) if len(self.keys) else np.zeros(0, np.int64)
        first = self.at[where[known]]
        many = self.at[where[known] + 1] - first
        rows = np.tile(self.absent[kind], (len(known), 1))
        entry = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows[np.repeat(np.arange(len(known)), many), self.lang[entry]] = self.value[entry]
        return known, rows

    def evidence(self, words: list[str]) -> np.ndarray:
        """Of each word, a number for each language."""
        out = np.zeros((len(words), len(self.langs)))
        known, rows = self.find(0, word_keys(words))
        out[known] = rows
        left = np.ones(len(words), bool)
        left[known] = False
        grams = Grams(words)
        for order in ORDERS:
            if not left.any():
                break
            keys, of = grams.keys(order, left)
            known, rows = self.find(order, keys)
            if len(known):
                some, first, many = np.unique(of[known], return_index=True, return_counts=True)
                out[some] = np.add.reduceat(rows, first, axis=0) / many[:, None]
                left[some] = False
        return out


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.most = max(64, CACHE_CELLS // max(1, len(model.langs)))
        #: Of each run met its words' evidence, and how many words it has.
        self.rows = np.zeros((self.most, len(model.langs)), np.float32)
        self.words = np.zeros(self.most, np.int64)
        self.known: dict[str, int] = {}

    def _learn(self, runs: list[str]) -> None:
        for at in range(0, len(runs), PART):
            part = runs[at : at + PART]
            words = [letters(r) for r in part]
            sizes = np.array([len(w) for w in words])
            evidence = self.model.evidence([w for ws in words for w in ws])
            k = len(self.known)
            self.rows[k : k + len(part)] = 0
            np.add.at(self.rows, np.repeat(np.arange(k, k + len(part)), sizes), evidence)
            self.words[k : k + len(part)] = sizes
            self.known.update(zip(part, range(k, k + len(part)), strict=True))

    def predict(self, text: str) -> tuple[str, float]:
        total, n = np.zeros(len(self.model.langs)), 0
        if self.model.langs:
            runs = _RUN.findall(text.lower())
            for at in range(0, len(runs), self.most // 4):  # a part's rows must stay while they are summed
                part = runs[at : at + self.most // 4]
                if len(self.known) + len(part) > self.most:
                    self.known.clear()
                new = [r for r in dict.fromkeys(part) if r not in self.known]
                if new:
                    self._learn(new)
                where = [self.known[r] for r in part]
                total += self.rows[where].sum(axis=0, dtype=np.float64)
                n += int(self.words[where].sum())
        if not n:
            return "und", 0.0
        scaled = total * min(1.0, EVIDENCE_WORDS / n)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(scaled - scaled[best]).sum())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: doc_id, text, lang. Held-out rows are left out."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    labelled = documents(docs, F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~F.coalesce(held, F.lit(True)))
    n, size = labelled.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, sample_docs / max(1, n), sample_bytes / max(1, size or 0))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else labelled
    counts = chosen.select("lang", "text").mapInArrow(_counted, _COUNTS).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    table = counts.toArrow().combine_chunks()  # as much as the sample's bounds allow
    langs = sorted(table.column("lang").unique().to_pylist())
    place = pc.index_in(table.column("lang"), pa.array(langs, pa.string())).to_numpy()
    return Model(langs, place.astype(np.int64), *[table.column(c).to_numpy() for c in ("kind", "key", "n")])


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [predictor.predict(t.as_py()) for t in batch.column(1)]
            arrays = [pa.array(ids, pa.int64()), pa.array([is_held_out(d) for d in ids], pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return documents(docs).mapInArrow(run, PREDICTION)
