"""Best-fit packing of token pieces into sequences, with certified repacking.

A document longer than the capacity is cut into full pieces, a shorter one first; every other document is one piece.
Full pieces are sequences of their own.  The rest is dealt evenly over groups of bounded size; each group is packed by
best-fit decreasing, and dual feasible functions give a lower bound of the sequences that its pieces need.  A group whose
count equals its bound is certified: only its emptiest sequence, which the bound's rounding leaves open, is given up.  A
group with a gap gives up every sequence with room in it.  What is given up is dealt anew over groups - documents change
partitions - and packed again, as long as that saves sequences; an arrangement is never replaced by a worse one.

Null texts are empty documents (the end id alone; without an end id they have no piece); repeated rows are packed each, and
dealt by the number of the row, so that they don't meet in one group; pieces of one length go in order of doc_id and piece,
and a piece that fits several sequences equally well goes to the one that was filled last; a very long text is encoded
whole, in one row, and cut; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import documents, materialize
from cardloom.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces in a group: some 2 MB. Groups of this size lose about one sequence each against packing all at once.
GROUP = 32768
#: A sequence with at most this share of its capacity free is never given up by a group with a gap.
TIGHT = 1 / 128
_PACKED = f"{PIECES}, row long, bin long, offset long, released boolean, bins long, bound long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, and a shorter one first."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if first and s == 0 else capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of 32-bit little-endian ids), and ids if asked for. No shuffle."""
    end = struct.pack("<I", end_id) if end_id is not None else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode_bytes(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    body = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(body), *([body] if with_ids else [])))
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return documents(docs).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that these lengths (1 to capacity) need at least: the best of two families of dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    # Small sizes up to t count nothing, those over capacity - t a whole sequence.
    small = np.cumsum(count * size)
    large = np.cumsum(count[::-1])[::-1]
    for t in range(1, capacity // 2 + 1):
        middle = int(small[capacity - t] - small[t - 1])
        best = max(best, int(large[capacity - t + 1]) - (-middle // capacity))
    # Sizes rounded to k-ths.
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For lengths in falling order: each one's bin and offset there, and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    held, bins = 0, 0  # held: bit r is set where a bin has r free
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = held >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                held ^= 1 << free
        else:
            b, free, bins = bins, capacity, bins + 1
        where[i], offset[i] = b, capacity - free
        if free > n:
            room[free - n].append(b)
            held |= 1 << (free - n)
    return where, offset, bins


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["group"]).combine_chunks()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        free = capacity - np.bincount(where, weights=lengths, minlength=bins)
        give = free > capacity * TIGHT if bins > bound else (np.arange(bins) == free.argmax()) & (free > 0)
        more = {"bin": where, "offset": offset, "released": give[where], "bins": np.full(len(where), bins), "bound": np.full(len(where), bound)}
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return run


def pack(pieces: DataFrame, capacity: int, rounds: int = 8) -> DataFrame:
    """Adds sequence_id and offset to rows of ``PIECES``. ``rounds`` bounds the exchanges, which end by themselves."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = materialize(pieces.select(*names, F.monotonically_increasing_id().alias("row")), "pieces")
    full = pieces.filter(F.col("length") >= capacity).select(*names, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = [full]
    pool, before = pieces.filter(F.col("length") < capacity), None
    count = pool.count()
    for turn in range(rounds):
        if not count:
            break
        groups = -(-count // GROUP)
        group = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups))
        dealt = pool.select(*names, "row", group.alias("group"))
        packed = materialize(
            dealt.groupBy("group").applyInArrow(_pack_group(capacity), _PACKED).withColumn("group", group), f"packed-{turn}"
        )
        each = packed.groupBy("group").agg(
            F.max("bins").alias("bins"), F.max("bound").alias("bound"), F.countDistinct(F.when(F.col("released"), F.col("bin"))).alias("loose"), F.count_if("released").alias("rows")
        )
        total = each.agg(F.sum("bins"), F.sum("loose"), F.sum("rows")).first()
        if before is not None and total[0] >= before:
            break  # the released sequences stay as they were
        if before is not None:
            placed.pop()
        sequence = (F.lit(turn + 1).cast("long") * F.lit(1 << 58)).bitwiseOR(F.col("group").cast("long") * F.lit(1 << 20)).bitwiseOR(F.col("bin"))
        rows = packed.select(*names, sequence.alias("sequence_id"), "offset", "released")
        placed += [rows.filter(~F.col("released")).drop("released"), rows.filter("released").drop("released")]
        pool, before, count = packed.filter("released").select(*names, "row"), total[1], total[2]
        if groups == 1:
            break
    else:
        warnings.warn(f"packing ended after {rounds} exchanges, the last of {count} pieces in {before} sequences", stacklevel=2)
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every id of every document, in as few sequences of
    at most ``capacity`` ids as the exchanges reach."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
