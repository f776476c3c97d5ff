"""Exact top-k search over vectors, identification and its decisions.

Up to ``QUERY_BYTES`` of queries are one matrix that goes to every task, so the index is read in place and not shuffled.
More queries than that never pass the driver: queries and index are cut into blocks of about ``BLOCK_BYTES``, and each
block of queries meets each block of the index in a task of its own.  Either way products are made in tiles of ``CELLS``
scores, and of a tile only rows are put out that can be among a query's best k so far; those alone are shuffled and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.sources.shared import kept

QUERY_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
CELLS = 4 << 20
HITS = "query_id long, pos long, score double"
#: Decimals that scores are compared in, so that equal vectors tie whatever block they are in.
DIGITS = 12
CONFIDENT, AMBIGUOUS = 0.7, 0.4
DECIDED, GAP = 0.6, 0.05
RETRY = 0.9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column)
    if column.null_count or len(column) and pc.any(pc.not_equal(sizes, dim)).as_py():
        raise ValueError(f"a vector hasn't {dim} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Best:
    """What of a stream of index rows can be among each query's best k: of equal scores, those with the smaller pos."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, leave_out: bool):
        self.ids, self.queries, self.k, self.leave_out = ids, queries, k + leave_out, leave_out
        #: A score that k rows have reached already.
        self.least = np.full(len(ids), -np.inf)

    def of(self, pos: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(pos)))
        for at in range(0, len(self.ids), step):
            yield self._tile(slice(at, at + step), pos, vectors)

    def _tile(self, some: slice, pos: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        scores = np.round(self.queries[some] @ vectors.T, DIGITS)
        if self.k < len(pos) and not np.isfinite(self.least[some]).all():
            kth = np.partition(scores, len(pos) - self.k, axis=1)[:, len(pos) - self.k]
            self.least[some] = np.maximum(self.least[some], kth)
        row, column = np.nonzero(scores >= self.least[some, None])
        found, score = pos[column], scores[row, column]
        many = np.bincount(row, minlength=scores.shape[0])
        if many.max(initial=0) > self.k:
            order = np.lexsort((found, -score, row))
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            order = order[place < self.k]
            row, found, score = row[order], found[order], score[order]
            many = np.minimum(many, self.k)
            whole = np.flatnonzero(many == self.k)
            self.least[some.start + whole] = np.maximum(self.least[some.start + whole], score[(np.cumsum(many) - 1)[whole]])
        ids = self.ids[some][row]
        if self.leave_out:
            other = ids != found
            ids, found, score = ids[other], found[other], score[other]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array(score)], ["query_id", "pos", "score"])


def _by_broadcast(queries: DataFrame, index: DataFrame, dim: int, k: int, leave_out: bool) -> DataFrame:
    table = queries.toArrow()
    best = (table.column("query_id").to_numpy(), _matrix(table.column("embedding"), dim), k, leave_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Best(*best)
        for batch in batches:
            if len(batch):
                yield from state.of(batch.column(0).to_numpy(), _matrix(batch.column(1), dim))

    return index.mapInArrow(run, HITS)


def _by_blocks(queries: DataFrame, index: DataFrame, dim: int, k: int, leave_out: bool, n: int) -> DataFrame:
    size = lambda rows: max(1, -(-8 * dim * rows // BLOCK_BYTES))
    down, across = size(n), size(index.count())
    block = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    q = queries.select(block("query_id", down).alias("i"), each(across).alias("j"), "query_id", "embedding")
    x = index.select(each(down).alias("i"), block("pos", across).alias("j"), "pos", "embedding")

    def run(mine: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(mine) and len(rows):
            state = Best(mine.column("query_id").to_numpy(), _matrix(mine.column("embedding"), dim), k, leave_out)
            for part in rows.to_batches(max_chunksize=10_000):
                out += state.of(part.column(2).to_numpy(), _matrix(part.column(3), dim))
        return pa.Table.from_batches(out, pa.schema([("query_id", pa.int64()), ("pos", pa.int64()), ("score", pa.float64())]))

    return q.groupBy("i", "j").cogroup(x.groupBy("i", "j")).applyInArrow(run, HITS)


def every_score(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, pos, score of each query (query_id, embedding) with each row of the index (pos, embedding). Nothing is
    ranked, so what is summed up by query isn't shuffled row by row."""
    return _candidates(queries, index, 1 << 30, False)


def topk(queries: DataFrame, index: DataFrame, k: int, leave_out: bool = False) -> DataFrame:
    """queries (query_id, embedding) against index (pos, embedding): query_id, rank (from 1), pos, score by inner product,
    best first, ties by pos. k <= 0 gives none; ``leave_out`` skips the row whose pos is the query's id."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    out = _candidates(queries, index, k, leave_out)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "pos", "score")


def _candidates(queries: DataFrame, index: DataFrame, k: int, leave_out: bool) -> DataFrame:
    """Rows that hold each query's best k."""
    q = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = index.select(F.col("pos").cast("long"), F.col("embedding").cast("array<float>"))
    n, dim = q.agg(F.count("*"), F.max(F.size("embedding"))).first() if k > 0 else (0, 0)
    if not n:
        return index.sparkSession.createDataFrame([], HITS)
    if 8 * n * dim <= QUERY_BYTES:
        return _by_broadcast(q, rows, dim, k, leave_out)
    return _by_blocks(q, rows, dim, k, leave_out, n)


#: Blocks that a blocked index has at most, rows of a task's part of one, and sampled rows that their centres are taken from.
BLOCKS, PART_ROWS, CENTRE_SAMPLE = 256, 1 << 15, 1 << 14
_SLACK = 1e-9


class BlockedIndex(NamedTuple):
    """rows: an index's pos and embedding with their block and part; blocks: centre, reach (the largest angle between the
    centre and a row), how many rows, and parts."""

    rows: DataFrame
    blocks: DataFrame


def _centres(index: DataFrame, blocks: int) -> np.ndarray:
    """Directions that are far from each other, out of a sample of bounded size: each the one farthest from those before."""
    sample = index.select("embedding").orderBy(F.xxhash64("pos")).limit(CENTRE_SAMPLE).toArrow().column("embedding").combine_chunks()
    if not len(sample):
        return np.zeros((0, 0))
    x = _matrix(sample, len(sample[0]))
    size = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(blocks, len(x)) and nearest.min() < 1 - _SLACK:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def block_index(index: DataFrame, path: str, blocks: int | None = None) -> BlockedIndex:
    """Writes an index (pos, embedding of norm one) under ``path``, each row with the nearest of at most ``BLOCKS`` centres
    (the square root of the rows, if that is less). A block's rows lie in parts of some ``PART_ROWS``."""
    spark = index.sparkSession
    n = index.count()
    centres = _centres(index, blocks or max(1, min(BLOCKS, int(n**0.5))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), centres.shape[1]) if batch.num_rows else np.zeros((0, centres.shape[1]))
            near = x @ centres.T
            best = near.argmax(axis=1)
            cosines = near[np.arange(len(x)), best]
            norms = np.linalg.norm(x, axis=1)
            angle = np.arccos(np.clip(np.divide(cosines, norms, out=np.ones_like(norms), where=norms > 0), -1, 1))
            columns = [batch.column("pos"), batch.column("embedding"), pa.array(best.astype(np.int32)), pa.array(angle), pa.array(norms)]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "embedding", "block", "angle", "norm"])

    rows = index.select(F.col("pos").cast("long").alias("pos"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.mapInArrow(assign, "pos long, embedding array<float>, block int, angle double, norm double").write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = assigned.groupBy("block").agg(F.count("*").alias("n"), F.max("angle").alias("reach"), F.max("norm").alias("norm"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    centre = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "block int, centre array<double>")
    sizes.join(F.broadcast(centre), "block").coalesce(1).write.parquet(f"{path}/blocks")  # BLOCKS rows at most
    parts = assigned.join(F.broadcast(spark.read.parquet(f"{path}/blocks").select("block", "parts")), "block")
    parts = parts.select("pos", "embedding", "block", F.pmod(F.xxhash64("pos"), F.col("parts")).cast("int").alias("part"))
    parts.repartition("block", "part").sortWithinPartitions("block", "part").write.parquet(f"{path}/rows")
    return open_blocked_index(spark, path)


def open_blocked_index(spark: SparkSession, path: str) -> BlockedIndex:
    return BlockedIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/blocks"))


def block_bounds(queries: DataFrame, index: BlockedIndex) -> DataFrame:
    """(query_id, block, n, parts, bound, near): the largest score that a row of a block can have with a query, and the cosine
    of query and centre. A query's few hundred blocks are a stated set, so this is no join of rows with rows."""
    from cardloom.functions.vectors import inner_product, norm

    pairs = queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")).join(F.broadcast(index.blocks))
    near = F.coalesce(F.try_divide(inner_product("q", "centre"), F.col("_qn")), F.lit(0.0))
    pairs = pairs.withColumn("_qn", norm("q")).withColumn("near", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near)))
    least = F.greatest(F.lit(0.0), F.acos("near") - F.col("reach"))  # the least angle between the query and a row
    most = F.cos(least) * F.col("_qn")
    bound = F.when(most > 0, most * F.col("norm")).otherwise(F.lit(0.0)) + F.lit(_SLACK)  # shorter rows only come nearer to zero
    return pairs.select("query_id", "block", "n", "parts", bound.alias("bound"), "near")


def _scored(pairs: DataFrame, queries: DataFrame, index: BlockedIndex, k: int) -> DataFrame:
    """The best k rows of each (query_id, block) asked for, part by part."""
    each = pairs.select("query_id", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = each.join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "query_id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("query_id").to_numpy()
        pos = right.column("pos").to_numpy()
        out = []
        if len(ids) and len(pos):
            dim = pc.list_value_length(right.column("embedding"))[0].as_py()
            best = Best(ids, _matrix(left.column("q"), dim), k, False)
            out = list(best.of(pos, _matrix(right.column("embedding"), dim)))
        return pa.Table.from_batches(out, pa.schema([("query_id", pa.int64()), ("pos", pa.int64()), ("score", pa.float64())]))

    return asked.groupBy("block", "part").cogroup(index.rows.groupBy("block", "part")).applyInArrow(run, HITS)


def topk_pruned(queries: DataFrame, index: BlockedIndex, k: int) -> DataFrame:
    """``topk`` over a blocked index, exactly: first each query's nearest blocks, until they hold k rows; their k-th score is
    one that the result reaches. Then only blocks whose bound isn't below it are read."""
    bounds = kept(block_bounds(queries, index), "bounds")
    near = Window.partitionBy("query_id").orderBy(F.desc("near"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = bounds.withColumn("_before", F.coalesce(F.sum("n").over(near), F.lit(0))).filter(F.col("_before") < k)
    hits = kept(_scored(first, queries, index, k), "hits")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    reached = hits.withColumn("place", place).filter(F.col("place") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(reached, "query_id", "left")
    rest = rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    every = hits.unionByName(_scored(rest, queries, index, k))
    return every.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "pos", "score")


def blocks_read(queries: DataFrame, index: BlockedIndex, k: int) -> DataFrame:
    """One row: pairs of query and block, and how many of them a search for the best k looks at."""
    bounds = block_bounds(queries, index)
    found = topk_pruned(queries, index, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    met = bounds.join(found, "query_id", "left")
    return met.agg(F.count("*").alias("pairs"), F.count_if(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).alias("needed"), F.sum("n").alias("rows"), F.sum(F.when(F.col("least").isNull() | (F.col("bound") >= F.col("least")), F.col("n"))).alias("needed_rows"))


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """hits joined with metadata by pos; negative positions, and those without a row, are left out."""
    return hits.filter("pos >= 0").join(metadata, "pos")


def classify_confidence(score: Column) -> Column:
    return F.when(score >= CONFIDENT, "CONFIDENT").when(score >= AMBIGUOUS, "AMBIGUOUS").otherwise("NO_MATCH")


def identify(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, similarity (of the best hit, else 0), confidence, candidates (positions, best first)."""
    each = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "pos"))).alias("ranked"))
    joined = queries.select("query_id").join(each, "query_id", "left")
    score = F.coalesce("best", F.lit(0.0))
    found = F.coalesce(F.transform("ranked", lambda r: r["pos"]), F.array().cast("array<long>"))
    return joined.select("query_id", score.alias("similarity"), classify_confidence(score).alias("confidence"), found.alias("candidates"))


def best_orientation(upright: DataFrame, rotated: DataFrame, threshold: float = RETRY) -> DataFrame:
    """Per query the upright hits; the rotated ones where the best upright score is below the threshold and the best
    rotated one is larger."""
    top = lambda hits, name: hits.groupBy("query_id").agg(F.max("score").alias(name))
    best = top(upright, "up").join(top(rotated, "turned"), "query_id", "full")
    turn = (F.coalesce("up", F.lit(0.0)) < threshold) & (F.coalesce("turned", F.lit(-2.0)) > F.coalesce("up", F.lit(0.0)))
    chosen = best.select("query_id", turn.alias("turn"))
    tagged = upright.withColumn("rotated", F.lit(False)).unionByName(rotated.withColumn("rotated", F.lit(True)))
    return tagged.join(chosen, "query_id").filter(F.col("rotated") == F.col("turn")).drop("turn")


def best_per_name(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "name").agg(F.max("score").alias("score"))


def _top_name(hits: DataFrame) -> DataFrame:
    return hits.withColumn("top_name", F.first("name").over(Window.partitionBy("query_id").orderBy("rank")))


def name_gap(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Best score less the best of another name among the hits: 1 with one name, 0 without hits."""
    gaps = _top_name(hits).groupBy("query_id").agg(
        F.coalesce(F.max("score") - F.max(F.when(~F.col("name").eqNullSafe(F.col("top_name")), F.col("score"))), F.lit(1.0)).alias("name_gap")
    )
    return queries.select("query_id").join(gaps, "query_id", "left").select("query_id", F.coalesce("name_gap", F.lit(0.0)).alias("name_gap"))


def hit_ranks(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """truth (query_id, gt_name, gt_pos): first rank of the exact row and of the name; -1 where absent."""
    joined = truth.join(hits, "query_id", "left").groupBy("query_id")
    first = lambda match: F.coalesce(F.min(F.when(match, F.col("rank"))), F.lit(-1))
    return joined.agg(first(F.col("pos") == F.col("gt_pos")).alias("exact_rank"), first(F.col("name") == F.col("gt_name")).alias("name_rank"))


def decide_match(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, confidence, similarity, gap, and the best hit's pos and name (null on NO_MATCH). Hits carry name."""
    best = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.min_by(F.struct("pos", "name"), "rank").alias("hit"))
    rows = name_gap(queries, hits).join(best, "query_id", "left")
    none = F.col("top").isNull() | (F.col("top") < AMBIGUOUS)
    level = F.when(none, "NO_MATCH").when((F.col("top") >= DECIDED) & (F.col("name_gap") >= GAP), "CONFIDENT").otherwise("AMBIGUOUS")
    card = lambda field: F.when(~none, F.col("hit")[field]).alias(field)
    return rows.select("query_id", level.alias("confidence"), F.coalesce("top", F.lit(0.0)).alias("similarity"), F.col("name_gap").alias("gap"), card("pos"), card("name"))


def parity_report(fresh: DataFrame, index: DataFrame) -> DataFrame:
    """fresh (pos, embedding) against the stored row of the same pos: rows, mean and least cosine, the worst row, how many
    find themselves first, and whether the least cosine exceeds 0.99."""
    from cardloom.functions.vectors import cosine

    pairs = fresh.select("pos", F.col("embedding").alias("new")).join(index.select("pos", "embedding"), "pos")
    cos = pairs.select("pos", cosine("new", "embedding").alias("cos"))
    own = topk(fresh.select(F.col("pos").alias("query_id"), "embedding"), index, 1).select(F.col("query_id").alias("pos"), (F.col("pos") == F.col("query_id")).alias("self"))
    return cos.join(own, "pos", "left").agg(
        F.count("*").alias("n"), F.avg("cos").alias("mean_cosine"), F.min("cos").alias("min_cosine"), F.min_by("pos", F.struct("cos", "pos")).alias("worst"),
        F.count_if(F.col("self")).alias("self_matches"), (F.min("cos") > 0.99).alias("passed"),
    )


def backend_agreement(rows: DataFrame) -> DataFrame:
    """rows (a, b, c: three embeddings of one input): their mean pairwise cosines."""
    from cardloom.functions.vectors import cosine

    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    return rows.agg(*[F.avg(cosine(x, y)).alias(f"cos_{x}{y}") for x, y in pairs])


def build_index(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors (pos, embedding, ...): the same, where every vector's size is checked as rows are read."""
    ok = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector hasn't {dim} dimensions")).cast("array<float>"))
    return vectors.withColumn("embedding", ok)


def append_index(index: DataFrame, more: DataFrame, order: str) -> DataFrame:
    """Rows of both; the new ones get positions after the old ones', in the given order. Counted per range of the order,
    so no task sees all rows."""
    start = index.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("start"))
    return index.unionByName(numbered(more, order).join(F.broadcast(start)).withColumn("pos", F.col("pos") + F.col("start")).drop("start"), allowMissingColumns=True)


def numbered(rows: DataFrame, *order: str | Column, name: str = "pos", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in that order; of the others, ``columns`` stay, or all. Ranges are sorted and numbered where
    they lie, kept, and shifted by the sizes of those before: rows are shuffled once."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id is the range's number in the high bits, and the row's place in the sorted range in the low 33.
    spread = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*(columns or rows.columns), F.monotonically_increasing_id().alias("_id"))
    local = kept(spread.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_n")).drop("_id"), "numbered")
    sizes = local.groupBy("_part").agg(F.count("*").alias("_size"))  # one row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return local.join(F.broadcast(shifts), "_part").withColumn(name, (F.col("_n") + F.col("_shift")).cast("long")).drop("_part", "_n", "_shift")


def places(rows: DataFrame, *order: str | Column, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All rows with their place in an order, from 1."""
    return numbered(rows, *order, name="place", columns=columns).withColumn("place", F.col("place") + 1)


def embed_batch(rows: DataFrame, predict, column: str, batch_size: int = 64) -> DataFrame:
    """Adds ``embedding``: what ``predict`` (a function of a numpy matrix, made in each worker by calling it) gives for
    the arrays in ``column``, L2-normalised. A null input is neutral (zeros)."""
    from pyspark.ml.functions import predict_batch_udf

    from cardloom.functions.vectors import l2_normalize

    width = rows.select(F.size(column).alias("n")).filter("n > 0").first()
    shape = [width[0] if width else 1]
    udf = predict_batch_udf(predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[shape])
    filled = F.coalesce(F.col(column).cast("array<float>"), F.array_repeat(F.lit(0.0), shape[0]).cast("array<float>"))
    return rows.withColumn("_raw", udf(filled)).withColumn("embedding", l2_normalize(F.col("_raw"))).drop("_raw")


