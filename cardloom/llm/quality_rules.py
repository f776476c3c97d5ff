"""Quality rules: plain limits first, then robust multivariate outliers.

Each text gives counts and a vector of five transformed statistics (square roots and a logarithm, shrunk for short texts
so that a few odd characters in ten words don't count like a thousand in a thousand).  Per language and source, the
minimum covariance determinant is estimated from all rows by concentration steps: distances to the present centre and
covariance, the ``SUBSET`` nearest rows, their mean and covariance, and again, from two starts, of which the smaller
determinant wins.  A step is one aggregation: counts and moments are summed per (group, distance bin), so the quantile
and the moments come from the same few rows per group, however hot the group is.  A text whose squared Mahalanobis
distance exceeds ``CUTOFF`` is rejected.

A group with fewer than ``LEAST_ROWS`` rows takes its language's estimate, or that of all rows where the language has too
few as well, or nothing (its rows keep their verdict from the plain limits).  Null languages and sources are groups of
their own.  Null texts have no words and fail; an empty table gives no rows; rows that repeat stay apart; of two starts with
one determinant the first wins, and rows in the distance bin that the subset ends in are all taken; a very long text is
one row, read in parts of a megabyte where it has several texts beside it; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import discard, documents, materialize, row_key, text_views, without
from cardloom.llm.words import SHINGLE, slices, window_hashes, word_hashes, word_spans

DIMENSIONS = 5
SUBSET = 0.6
STEPS = 6
LEAST_ROWS = 200
#: Standard deviations below which a statistic is not held against a text.
FLOORS = np.array([0.06, 0.06, 0.05, 0.08, 0.08])
#: Three in a thousand normal vectors lie beyond the cutoff; the floors keep clean texts far within it.
TAIL = 0.003
BINS_PER_E = 32

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = f"doc_id long, lang string, source string, {COUNTS}, v array<double>"
_KINDS = {"symbols": b"#*$%&|<>", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": b".,!?;:"}


def chi_square_cdf(x: float, d: float) -> float:
    """The regularised lower incomplete gamma function, by its series or continued fraction."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    f = 1e-300
    c, dd = x + 1 - a, 0.0
    b, f = x + 1 - a, 1 / (x + 1 - a)
    dd, c = f, 1e300
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        dd = 1 / (an * dd + b)
        c = b + an / c
        f *= c * dd
        if abs(c * dd - 1) < 1e-15:
            break
    return 1 - scale * f


def chi_square_quantile(p: float, d: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, d) < p else (lo, mid)
    return hi


CUTOFF = chi_square_quantile(1 - TAIL, DIMENSIONS)
#: What makes the covariance of the nearest part of a normal sample that of the whole.
CONSISTENCY = SUBSET / chi_square_cdf(chi_square_quantile(SUBSET, DIMENSIONS), DIMENSIONS + 2)


def _repeated(windows: np.ndarray) -> int:
    """Words in windows that occur twice or more."""
    if len(windows) < 2:
        return 0
    ordered = np.sort(windows)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(len(windows) + SHINGLE, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + SHINGLE, -1)
    return int((np.cumsum(covered) > 0).sum())


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def counts(data: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    """For texts that lie one after another: the base counts and what the vectors need."""
    n = len(places) - 1
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "marks", "adjacent")}
    for lo, hi in slices(places):
        at = places[lo : hi + 1] - places[lo]
        own = data[places[lo] : places[hi]]
        if not len(own):
            continue

        def per_text(mask: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            sums = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=sums[1:])
            return sums[at[1:]] - sums[at[:-1]]

        table = np.zeros((3, 256), bool)
        for row, chars in zip(table, _KINDS.values(), strict=True):
            row[list(chars)] = True
        starts, ends, of = word_spans(own, at)
        words = word_hashes(own, starts, ends)
        windows = window_hashes(words)
        out["n_words"][lo:hi] = np.diff(of)
        inside = np.ones(256, bool)
        inside[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False
        out["word_chars"][lo:hi] = per_text(inside[own])
        for row, name in zip(table, ("n_symbols", "upper", "marks"), strict=True):
            out[name][lo:hi] = per_text(row[own])
        again = np.zeros(len(words) + 1, np.int64)
        if len(words) > 1:
            again[2:] = np.cumsum(words[1:] == words[:-1])
        raw = own.tobytes()
        for k, (a, b, x, y) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True), lo):
            if b - a >= SHINGLE:
                out["n_repeat_words"][k] = _repeated(windows[a : b - SHINGLE + 1])
            if b - a > 1:
                out["adjacent"][k] = again[b] - again[a + 1]
            out["n_dup_lines"][k] = _repeated_lines(raw[x:y])
    return out


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = c["n_words"].astype(float), c["word_chars"].astype(float)
    return np.stack(
        [
            np.log((chars + 100) / (words + 20)),
            np.sqrt(c["n_symbols"] / (chars + 50)),
            np.sqrt(c["upper"] / (chars + 50)),
            np.sqrt(c["adjacent"] / (words + 20)),
            np.sqrt(c["marks"] / (words + 20)),
        ],
        axis=1,
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = counts(*text_views(batch))
        v = vectors(c)
        arrays = [batch.column(0), batch.column(2), batch.column(3)] + [pa.array(c[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        arrays.append(pa.array(list(v), pa.list_(pa.float64())))
        names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "v"]
        yield pa.RecordBatch.from_arrays(arrays + batch.columns[4:], names + batch.schema.names[4:])


def _groups(docs: DataFrame) -> list[Column]:
    return [docs[c].cast("string").alias(c) for c in ("lang", "source")]


def text_statistics(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, lang, source, the five counts, the vector v and, where it is asked for, the row's key. No shuffle."""
    more = [row_key(F.col("doc_id"), F.col("text"), docs["lang"], docs["source"]).alias("row")] if keyed else []
    return documents(docs, *_groups(docs), *more).mapInArrow(_statistics, _SCHEMA + (", row string" if keyed else ""))


def _keyed(stats: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the key of the group whose estimate a row takes; null where there are too few rows at all. The groups' sizes
    need no text."""
    by_source = docs.select(*_groups(docs)).groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    total = by_lang.agg(F.sum("n_lang").alias("n_all"))
    text = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    key = F.when(F.col("n") >= LEAST_ROWS, text).when(F.col("n_lang") >= LEAST_ROWS, F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})).when(F.col("n_all") >= LEAST_ROWS, "{}")
    sizes = by_source.join(by_lang.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).drop("l").crossJoin(F.broadcast(total))
    sizes = sizes.select(F.struct(F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("g"), key.alias("key"))
    row_group = F.struct(F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull())
    return stats.withColumn("g", row_group).join(sizes, "g", "left").drop("g")


_FIT = "key string, start int, mean array<double>, inverse array<double>, logdet double"


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and moments of the nearest rows to centres, inverse covariances and determinants."""
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    for frame in batches:
        out = []
        for key, start, n, sums, products in frame[["key", "start", "n", "sums", "products"]].itertuples(index=False):
            mean = np.asarray(sums, float) / n
            cov = np.zeros((DIMENSIONS, DIMENSIONS))
            for (i, j), p in zip(pairs, products, strict=True):
                cov[i, j] = cov[j, i] = p / n - mean[i] * mean[j]
            cov = CONSISTENCY * cov + np.diag(FLOORS**2)
            out.append((key, start, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["key", "start", "mean", "inverse", "logdet"])


def _distance(v: str = "v"):
    """Squared Mahalanobis distance of v to ``mean`` by ``inverse``."""
    gap = F.zip_with(v, "mean", lambda x, m: x - m)
    rows = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: _dot(F.slice("inverse", i * DIMENSIONS + 1, DIMENSIONS), gap))
    return _dot(rows, gap)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _concentrated(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One step: from the present fits to those of each group's nearest rows."""
    near = rows.join(fits.select("key", "start", "mean", "inverse"), "key").withColumn("bin", F.floor(F.log(_distance() + 1e-9) * BINS_PER_E).cast("int"))
    moments = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
    moments += [F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}_{j}") for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    binned = near.groupBy("key", "start", "bin").agg(F.count("*").alias("c"), *moments)
    up_to = F.expr("sum(c) over (partition by key, start order by bin rows between unbounded preceding and current row) - c")
    whole = F.expr("sum(c) over (partition by key, start)")
    inner = binned.withColumns({"before": up_to, "all": whole}).filter(F.col("before") < SUBSET * F.col("all"))
    names = [f"s{i}" for i in range(DIMENSIONS)], [f"p{i}_{j}" for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    summed = inner.groupBy("key", "start").agg(F.sum("c").alias("n"), *[F.sum(x).alias(x) for part in names for x in part])
    return summed.select("key", "start", "n", F.array(*names[0]).alias("sums"), F.array(*names[1]).alias("products")).mapInPandas(_solved, _FIT)


def robust_fits(rows: DataFrame) -> DataFrame:
    """rows (key, v) to (key, mean, inverse): each group's minimum covariance determinant estimate."""
    parts = F.array(*[F.percentile_approx(F.col("v")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000) for i in range(DIMENSIONS)])
    middle = rows.groupBy("key").agg(parts.alias("q"))
    floor = F.array(*[F.lit(float(x)) for x in FLOORS])
    scale = F.zip_with(F.transform("q", lambda x: (x[2] - x[0]) / 1.349), floor, lambda s, f: s * s + f * f)
    cells = lambda of: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda j: F.when(i == j, of(i)).otherwise(0.0))))
    starts = middle.select("key", F.transform("q", lambda x: x[1]).alias("mean"), scale.alias("scale"))
    one = starts.select("key", F.lit(1).alias("start"), "mean", cells(lambda i: 1 / F.get("scale", i)).alias("inverse"), F.lit(0.0).alias("logdet"))
    two = starts.select("key", F.lit(2).alias("start"), "mean", cells(lambda i: F.lit(1.0)).alias("inverse"), F.lit(0.0).alias("logdet"))
    fits = materialize(one.unionByName(two), "fits")
    for _ in range(STEPS):
        before, fits = fits, materialize(_concentrated(rows, fits), "fits")
        discard(before)
    best = fits.groupBy("key").agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "start")).alias("b"))
    return materialize(best.select("key", "b.mean", "b.inverse"), "fit")


def judge_quality(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed, distance (null without an estimate), kept; and the row's key,
    where it is asked for."""
    stats = materialize(_keyed(text_statistics(docs, keyed), docs), "statistics")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    fits = robust_fits(stats.filter(F.col("key").isNotNull()).select("key", "v"))
    judged = stats.join(fits, "key", "left").withColumn("base_failed", failed).withColumn("distance", _distance())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return judged.select("doc_id", "lang", "source", *names, "base_failed", "distance", kept.alias("kept"), *(["row"] if keyed else []))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is to stay, with all their columns. Rows are told apart by doc_id, text, lang and source,
    so that only rows of one verdict go together, whether their doc_id is null or repeats."""
    gone = judge_quality(docs, keyed=True).filter("not kept").select(F.col("row").alias("key"))
    return without(docs, row_key(docs["doc_id"], docs["text"], docs["lang"], docs["source"]), gone)
