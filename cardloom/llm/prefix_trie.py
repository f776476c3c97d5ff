"""The trie of conversation prefixes, by peeling turns off from the deepest level up.

1. Each conversation becomes a path: for every turn a 128-bit key that stands for all turns up to it, and the number of
   code points so far.  Texts are read once, hashed where they are read, and only hashes are gathered in a conversation.
   Equal paths are one row with the number of conversations and the smallest conv_id, combined before the shuffle.
2. From the maximum depth down, the nodes that survive from the level below, and the conversations that end at this one,
   are grouped by their path: one aggregation gives a level's nodes with members, children, leaves and saved tokens all
   at once.  Then the last turn is stripped, and nodes that fall together are merged with the next conversations to end.
   Every level is a table in the shared folder, which holds no more rows than the level has nodes.
3. Where no two nodes meet over ``STRIDE`` levels or more (the few conversations that are far longer than all others), as
   many turns are stripped at once as keep them apart, found by halving; each such node is alone on its chain.
4. The ids that end at a node are sorted by (node, conv_id) over all tasks, joined to pieces where they lie, and the
   pieces of a node hashed in order, as a stream; no task holds a node's ids.

Turns are ordered by (turn, role, text), nulls first, so ties are told apart and rows that repeat are turns each; null
roles and texts are empty; rows without a conv_id belong to no conversation and are left out.  A negative conv_id's hundred
is the next one towards zero.  A very long text counts by its hash; a conversation of very many turns is a path of 24 bytes
a turn in one row.  An empty table gives no rows, as no conversation stands at the root.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.common import discard, materialize

#: Bytes of a node's key, and of a count of code points.
KEY, COUNT = 16, 8
#: The first turns of a hundred's first conversation that others may begin with: fewer than this.
SHARED = 6
HUNDRED = 100
#: Levels that must be without a meeting of nodes for them to be stripped at once.
STRIDE = 8
#: Bytes of ids that are joined before they are put out.
PIECE = 1 << 16

_NODE = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of hash and code points): the first turns of the hundred's first conversation, then its own.
    Conversations of one hundred share a partition, so one shuffle serves the order, the gathering and the exchange."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(conv.alias("conv_id"), (conv - conv % HUNDRED).alias("hundred"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.filter("conv_id is not null").repartition("hundred")
    order = Window.partitionBy("hundred", "conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    print_ = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = rows.withColumn("at", F.row_number().over(order))
    turns = turns.select("hundred", "conv_id", F.struct("at", F.substring(print_, 1, KEY).alias("print"), F.length("text").alias("chars")).alias("t"))
    own = turns.groupBy("hundred", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("hundred"), F.slice("own", 1, SHARED - 1))).over(Window.partitionBy("hundred"))
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    lent = F.coalesce(F.slice(first, F.lit(1), h), F.array().cast("array<struct<at:int,print:binary,chars:int>>"))
    kept = F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1)))
    return own.withColumn("lent", lent).select("conv_id", F.transform(F.concat("lent", kept), lambda t: F.struct(t["print"], t["chars"])).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = batch.column(1)
        flat = turns.flatten()
        prints, chars = (flat.field(k).to_pylist() for k in (0, 1))
        sizes = [0 if x is None else x for x in turns.value_lengths().to_pylist()]
        at, keys, counts = 0, [], []
        for n in sizes:
            key, sums, total, path = b"", [], 0, []
            for k in range(at, at + n):
                key = hashlib.sha256(key + prints[k]).digest()[:KEY]
                total += chars[k]
                path.append(key)
                sums.append(total)
            keys.append(b"".join(path))
            counts.append(struct.pack(f">{n}q", *sums))
            at += n
        columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "path", "counts"])


def _key(depth: Column | int) -> Column:
    """The key of a path's node at a depth; the root's is empty."""
    at = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring(F.col("path"), (at - 1) * KEY + 1, F.when(at > 0, KEY).otherwise(0))


def _count(depth: Column | int) -> Column:
    """Code points up to a depth."""
    at = F.lit(depth) if isinstance(depth, int) else depth
    number = F.conv(F.hex(F.substring(F.col("counts"), (at - 1) * COUNT + 1, F.lit(COUNT))), 16, 10).cast("long")
    return F.when(at > 0, number).otherwise(F.lit(0).cast("long"))


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of the level below ``depth`` as members of their parents."""
    cut = lambda name, width: F.substring(F.col(name), 1, depth * width).alias(name)
    return nodes.select(cut("path", KEY), cut("counts", COUNT), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def _level(members: DataFrame, depth: int) -> DataFrame:
    """The nodes of one level from their children and the conversations that end there."""
    sums = [F.sum(c).alias(c) for c in _NODE[1:]]
    nodes = members.groupBy("path", "counts").agg(F.min("conv_id").alias("conv_id"), *sums)
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * (_count(depth) - _count(max(0, depth - 1)))
    keys = _key(depth).alias("key"), _key(max(0, depth - 1)).alias("parent")
    return nodes.select(F.lit(depth).cast("long").alias("depth"), *keys, "conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), "path", "counts")


def _apart(pool: DataFrame, depth: int) -> bool:
    """Whether all paths of the pool still differ in their first ``depth`` turns."""
    n, different = pool.agg(F.count("*"), F.count_distinct(_key(depth))).first()
    return n == different


def _chains(pool: DataFrame, low: int) -> DataFrame:
    """The nodes of paths that don't meet, from each one's ``high`` up to the depth ``low``."""
    at = F.col("at")
    each = pool.withColumn("at", F.explode(F.sequence(F.lit(low), F.col("high"))))
    children = F.when((at == F.col("high")) & F.col("leaf"), 0).otherwise(1).cast("long")
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * (_count(F.col("high")) - _count(at - 1))
    rest = [F.when(at == low, F.substring(c, 1, low * width)).alias(c) for c, width in (("path", KEY), ("counts", COUNT))]
    return each.select(at.cast("long").alias("depth"), _key(at).alias("key"), _key(at - 1).alias("parent"), "conv_id", "n_convs", children.alias("n_children"), "n_leaves", saved.alias("saved_tokens"), *rest)


def _pool(ended: DataFrame, top: DataFrame | None, at: int, depth: int) -> DataFrame:
    """The nodes of the level ``at`` and the conversations that end above it, below ``depth``."""
    new = ended.filter((F.col("depth") > depth) & (F.col("depth") < at))
    out = new.select("path", "counts", "conv_id", "n_convs", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens", F.col("depth").alias("high"), F.lit(True).alias("leaf"))
    if top is not None:
        out = out.unionByName(top.select("path", "counts", "conv_id", "n_convs", "n_leaves", "saved_tokens", F.lit(at - 1).alias("high"), F.lit(False).alias("leaf")))
    return out


def _peel(ended: DataFrame, deepest: int) -> list[DataFrame]:
    """ended (depth, path, counts and a node's columns) to the nodes of all levels, in tables."""
    levels, top, at, wait = [], None, deepest + 1, deepest + 1
    while at > 0:  # ``at``: the level that ``top`` holds
        if at <= wait and at > STRIDE:
            low = at - STRIDE  # nodes at depths over ``low`` are each alone if the pool's paths are apart at low + 1
            if _apart(_pool(ended, top, at, low), low + 1):
                least = 0
                while least < low:  # the least such depth
                    half = (least + low) // 2
                    least, low = (least, half) if _apart(_pool(ended, top, at, half), half + 1) else (half + 1, low)
                levels.append(materialize(_chains(_pool(ended, top, at, low), low + 1), "level"))
                top, at = levels[-1].filter(F.col("depth") == low + 1), low + 1
            wait = at - STRIDE
        at -= 1
        members = ended.filter(F.col("depth") == at).select("path", "counts", *_NODE)
        if top is not None:
            members = members.unionByName(_stripped(top, at))
        top = materialize(_level(members, at), "level")
        levels.append(top)
    return levels


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order of (key, conv_id) to pieces of one key each, as decimals joined by commas."""
    for batch in batches:
        keys, ids = (batch.column(k).to_pylist() for k in (0, 1))
        rows, begin = [], 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[begin] or k - begin >= PIECE // 8:
                rows.append((keys[begin], ids[begin], ",".join(map(str, ids[begin:k]))))
                begin = k
        columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, (pa.binary(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "first", "piece"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to the SHA-256 of each key's."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + piece.encode())
                continue
            if digest:
                out.append((key, digest.hexdigest()))
            key, digest = k, hashlib.sha256(piece.encode())
        yield _ends(out)
    if digest:
        yield _ends([(key, digest.hexdigest())])


def _ends(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    keys, digests = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, conv_id) to (key, ends_sha256) over each key's ids in ascending order."""
    pieces = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, "key binary, first long, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "piece").mapInArrow(_hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    spark = conversations.sparkSession
    paths = materialize(rebuilt(conversations).mapInArrow(_paths, "conv_id long, depth int, path binary, counts binary"), "paths")
    zero = F.lit(0).cast("long")
    ended = paths.groupBy("depth", "path", "counts").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    ended = ended.select("*", zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens")).sortWithinPartitions("depth")
    ended = materialize(ended, "ended")
    deepest = ended.agg(F.max("depth")).first()[0]
    none = hashlib.sha256(b"").hexdigest()
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if deepest is None:
        kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns)
        return spark.createDataFrame([], kinds)
    levels = _peel(ended, deepest)
    nodes = levels[0].drop("path", "counts")
    for level in levels[1:]:
        nodes = nodes.unionByName(level.drop("path", "counts"))
    nodes = materialize(nodes, "nodes")
    discard(ended, *levels)
    ends = materialize(end_hashes(paths.select(_key(F.col("depth")).alias("key"), "conv_id")), "ends")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))).join(above, "parent", "left").join(ends, "key", "left")
    return out.select(*columns[:-1], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
