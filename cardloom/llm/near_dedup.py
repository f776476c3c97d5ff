"""Near-duplicate documents by MinHash with odd sketches, confirmed on full shingle sets.

1. One scan makes each document's set of distinct 5-word shingles (64-bit hashes), ``SAMPLES`` MinHash values, band keys
   over them, and an odd sketch: each (sample, value) flips one bit of a bitmap, so that the XOR of two bitmaps has about
   as many bits set as the samples differ in, and tells high similarities apart precisely.
2. Documents with the same words in the same order are one class, with its smallest doc_id for all: copies are never
   expanded into pairs.
3. In each bucket of classes with one band key, all are compared with one pivot, the class that shares most bands with
   others: of a family around one text, that is the text.  That is one row per member, not per pair.  Pairs whose
   sketches rule out the similarity (to about one in a million) go; the rest are confirmed on the full sets of the whole
   texts, streamed past their pivot in salted runs of bounded length.
4. In buckets whose members then still lie in different components, the members outside the largest component are
   compared with all, in tiles of bounded size, sketch by sketch.  There a second odd sketch, of the whole sets, decides
   almost alone: the XOR of two such bitmaps never has more bits set than the sets differ in, so a pair with too many is
   surely not similar.  Of the pairs that pass, a tile emits those of a spanning forest over its components, the best
   first: no more rows than members.  They are confirmed and the components merged.  Where a pair of a forest turns out
   not to be similar, the bucket is taken again, with twice as many pairs beyond the forest, until every pair that passes
   lies in one component or has been compared in full.
5. Components come from the confirmed links alone, over all rounds; each round starts from the last one's stars.

With 32 bands of 4 samples a pair at similarity 0.75 shares no band with probability 5e-6.

Lower-casing is A-Z only. A text of fewer than five words is one shingle; without words or text, a document has none and
is linked with nothing. A very long text is one row like any other: its shingles, 8 bytes a word, must fit into a worker.
Of equal choices (pivots, forests) the smaller doc_id is taken, so that a result doesn't depend on partitions. Different
texts with one doc_id are documents of their own, whose classes go by a hash instead of the doc_id; of such ones in one
component, a single class is kept. Rows that repeat get the same result each. A null doc_id is linked with nothing and has
a null component. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import bit_filter, discard, documents, materialize, row_key, text_views, with_filter, without
from cardloom.llm.components import components
from cardloom.llm.words import mix, sequence_hash, shingle_sets

SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: XOR bits that a pair at similarity 0.75 exceeds about once in a million: 57 on average, standard deviation 10.4.
SKETCH_LIMIT = 110
#: Members that one run past a pivot holds, and classes in the side of a tile.
RUN, TILE = 256, 1024
PERCENT = 75
#: Bytes of the odd sketch of a whole set of up to 8 times as many shingles; larger sets have 2, 4, 8 ... times as many.
PARITY = 512

_RNG = np.random.Generator(np.random.PCG64(29))
_A = (_RNG.integers(0, 1 << 32, SAMPLES, np.uint64) | 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32)
_SAMPLE = _RNG.integers(0, 1 << 64, SAMPLES, np.uint64)
_ROW = _RNG.integers(0, 1 << 64, SAMPLES, np.uint64) | np.uint64(1)

SIGNATURE = "doc_id long, row string, content binary, n_shingles long, bands array<long>, sketch array<long>, parity binary"
_SIGNED = [x.split()[0] for x in SIGNATURE.split(", ")]


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least of each of ``SAMPLES`` hash functions over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        block = x[at : at + 1024, None] * _A
        block += _B
        np.minimum(least, block.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    keyed = (mix(samples.astype(np.uint64) ^ _SAMPLE) * _ROW).reshape(BANDS, ROWS)
    return mix(keyed.sum(axis=1, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bits = mix(samples.astype(np.uint64) + _SAMPLE) % np.uint64(SKETCH_BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set."""
    size = PARITY
    while len(shingles) > 8 * size:
        size *= 2
    odd = np.bincount((mix(shingles) & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """The same set's odd sketch of fewer bytes."""
    while len(parity) > size:
        half = len(parity) // 2
        parity = parity[:half] ^ parity[half:]
    return parity


def may_be_similar(differ: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles that differ in at least so many can have the similarity."""
    return differ * (100 + PERCENT) <= (100 - PERCENT) * (a + b)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = text_views(batch)
        content, sizes, bands, sketches, parities = [], [], [], [], []
        for words, shingles in shingle_sets(data, places):
            content.append(sequence_hash(words, 3).to_bytes(8, "little") + sequence_hash(words, 5).to_bytes(8, "little"))
            sizes.append(len(shingles))
            samples = minhash(shingles) if len(shingles) else None
            bands.append(band_keys(samples) if samples is not None else None)
            sketches.append(odd_sketch(samples) if samples is not None else None)
            parities.append(parity_sketch(shingles).tobytes() if samples is not None else None)
        longs = pa.list_(pa.int64())
        arrays = [batch.column(0), batch.column(2), pa.array(content, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, longs), pa.array(sketches, longs), pa.array(parities, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, _SIGNED)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of distinct shingles have at least the similarity."""
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (pivot, salt, role): a pivot's texts (role 0), then members'. Links are those that are similar."""
    key, pivots = None, []
    for batch in batches:
        a, b = [], []
        data, places = text_views(batch)
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("pivot", "salt", "role", "id")]
        for pivot, salt, role, member, (_, shingles) in zip(*columns, shingle_sets(data, places), strict=True):
            if (pivot, salt) != key:
                key, pivots = (pivot, salt), []
            if role == 0:
                pivots.append(shingles)
            elif any(similar(p, shingles) for p in pivots):
                a.append(pivot)
                b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirmed(pairs: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (pivot, id) of classes, the links (a, b). reps (id, row) and texts (row, text): only texts of documents in
    pairs are shuffled (and a few others)."""
    ids = pairs.select("id").unionByName(pairs.select(F.col("pivot").alias("id"))).distinct()
    wanted = materialize(ids.join(reps.hint("merge"), "id").select("id", "row"), "wanted")
    some = with_filter(texts, bit_filter(wanted, "row"), "row", flag="_in").filter("_in")
    # Rows that repeat are one text, and meet before the shuffle.
    some = wanted.join(some.select("row", "text").dropDuplicates(["row"]).hint("merge"), "row").select("id", "text")
    size = pairs.groupBy("pivot").agg(F.count("*").alias("n")).select(F.col("pivot").bitwiseOR(F.lit(0)).alias("pivot"), "n")
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / RUN)).cast("int")
    salted = materialize(pairs.join(size.hint("merge"), "pivot").select("pivot", salt.alias("salt"), "id"), "salted")
    members = salted.select("pivot", "salt", F.lit(1).alias("role"), "id")
    heads = salted.select("pivot", "salt").distinct().select("pivot", "salt", F.lit(0).alias("role"), F.col("pivot").bitwiseOR(F.lit(0)).alias("id"))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = members.unionByName(heads).join(some.hint("merge"), "id").repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    links = materialize(runs.mapInArrow(_confirm, "a long, b long").distinct(), "links")
    discard(salted, wanted)
    return links


def _differing_bits(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _by_sketch(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (pivot, id), those whose sketches leave the similarity possible."""
    one = sketches.select(F.col("id").alias("pivot"), F.col("sketch").alias("x"))
    two = sketches.select("id", F.col("sketch").alias("y"))
    return pairs.join(one.hint("merge"), "pivot").join(two.hint("merge"), "id").filter(_differing_bits("x", "y") <= SKETCH_LIMIT).select("pivot", "id").distinct()


def spanning_forest(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of edges between nodes a and b, best first, those of a spanning forest over the nodes' labels."""
    _, labels = np.unique(labels, return_inverse=True)
    chosen = np.zeros(len(a), bool)
    while len(a):
        x, y = labels[a], labels[b]
        open_ = np.flatnonzero((x != y) & ~chosen)
        if not len(open_):
            break
        best = np.full(labels.max() + 1, len(a))
        np.minimum.at(best, x[open_], open_)
        np.minimum.at(best, y[open_], open_)
        new = np.unique(best[best < len(a)])
        chosen[new] = True
        root = np.arange(labels.max() + 1)
        while True:  # each label takes the smallest that its new edges reach
            low = np.minimum(root[x[new]], root[y[new]])
            after = root.copy()
            np.minimum.at(after, x[new], low)
            np.minimum.at(after, y[new], low)
            after = after[after]
            if (after == root).all():
                break
            root = after
        labels = root[labels]
    return chosen


def _tile(beyond: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs of one tile that lie in different components and whose sketches pass: a spanning forest's, and of the others
    the best, so many per row of the tile. ``more`` tells that some are left."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("id", "ascending"), ("side", "ascending")])
        key = table.column("key")[0].as_py()
        ids, comp, sizes, side, minor = (table.column(n).to_numpy(zero_copy_only=False) for n in ("id", "comp", "n_shingles", "side", "minor"))
        sketch = np.array(table.column("sketch").to_pylist(), np.int64).reshape(len(ids), SKETCH_WORDS).view(np.uint64)
        parity = [np.frombuffer(x, np.uint8) for x in table.column("parity").to_pylist()]
        short = np.array([folded(x, PARITY) for x in parity]).reshape(len(ids), PARITY).view(np.uint64)
        wide = np.array([len(x) > PARITY for x in parity])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found, scores = [], []
        for i in left.tolist():
            other = right[(comp[right] != comp[i]) & (~minor[right] | (ids[right] > ids[i]))]
            other = other[np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1) <= SKETCH_LIMIT]
            differ = np.bitwise_count(short[other] ^ short[i]).sum(axis=1, dtype=np.int64)
            passed = may_be_similar(differ, sizes[i], sizes[other])
            other, differ = other[passed], differ[passed]
            if wide[i] and wide[other].any():
                for k in np.flatnonzero(wide[other]).tolist():
                    width = min(len(parity[i]), len(parity[other[k]]))
                    differ[k] = np.bitwise_count(folded(parity[i], width) ^ folded(parity[other[k]], width)).sum(dtype=np.int64)
                passed = may_be_similar(differ, sizes[i], sizes[other])
                other, differ = other[passed], differ[passed]
            found.append(np.stack([np.full(len(other), i), other]))
            scores.append(differ / (sizes[i] + sizes[other]))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        order = np.argsort(np.concatenate(scores) if scores else np.zeros(0), kind="stable")
        a, b = a[order], b[order]
        forest = spanning_forest(a, b, comp)
        rest = np.flatnonzero(~forest)
        taken = np.concatenate([np.flatnonzero(forest), rest[: beyond * len(ids)]])
        pivots, members = np.minimum(ids[a], ids[b])[taken], np.maximum(ids[a], ids[b])[taken]
        more = np.full(len(taken), len(taken) < len(a))
        return pa.table({"key": np.full(len(taken), key), "pivot": pivots, "id": members, "more": more})

    return run


def _open_pairs(rows: DataFrame, known: DataFrame, sketches: DataFrame, beyond: int) -> DataFrame:
    """rows (key, id) to (key, pivot, id, more): pairs of one bucket in different components. The members outside a
    bucket's largest component (n of m) meet all: n * m / TILE rows each way, and no more pairs than those."""
    held = rows.join(known.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    held = materialize(held.select("key", "id", "comp"), "held")
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    buckets = buckets.select(F.col("key").bitwiseOR(F.lit(0)).alias("key"), F.col("top.comp").alias("largest"), tiles(F.col("m") - F.col("top.n")).alias("down"), tiles(F.col("m")).alias("across"))
    dealt = held.join(buckets.hint("merge"), "key").withColumn("minor", F.col("comp") != F.col("largest")).join(sketches.hint("merge"), "id")
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    as_one = F.transform(places("across"), lambda j: F.struct(place("down").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    as_other = F.transform(places("down"), lambda i: F.struct(i.alias("i"), place("across").alias("j"), F.lit(1).alias("side")))
    spots = F.explode(F.when(F.col("minor"), F.concat(as_one, as_other)).otherwise(as_other)).alias("at")
    spread = dealt.select("key", "id", "comp", "minor", "n_shingles", "sketch", "parity", spots).select("key", "at.i", "at.j", "at.side", "id", "comp", "minor", "n_shingles", "sketch", "parity")
    pairs = materialize(spread.groupBy("key", "i", "j").applyInArrow(_tile(beyond), "key long, pivot long, id long, more boolean"), "pairs")
    discard(held)
    return pairs


def _components(rows: DataFrame, sketches: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (key, id, pivot) to (node, component): the smallest class that each linked class can reach."""
    tried = materialize(_by_sketch(rows.filter("id <> pivot").select("pivot", "id").distinct(), sketches), "tried")
    known = materialize(components(_confirmed(tried, reps, texts)), "components")
    tried = tried.select(F.least("pivot", "id").alias("pivot"), F.greatest("pivot", "id").alias("id"))
    rows = rows.select("key", "id")
    for turn in count():
        found = _open_pairs(rows, known, sketches, 0 if turn == 0 else 1 << turn)
        fresh = materialize(found.select("pivot", "id").distinct().join(tried.hint("merge"), ["pivot", "id"], "left_anti"), "tried")
        new = _confirmed(fresh, reps, texts)
        tried = tried.unionByName(fresh)
        if not new.isEmpty():  # else the components are what they were
            stars = known.select(F.col("component").alias("a"), F.col("node").alias("b"))
            merged = materialize(components(stars.unionByName(new)), "components")
            discard(known)
            known = merged
        # Only where pairs are left, and one that a forest rests on isn't a link, can there be more to find.
        failed = found.filter("more").join(new.select(F.col("a").alias("pivot"), F.col("b").alias("id")).hint("merge"), ["pivot", "id"], "left_anti")
        failed = materialize(failed.select(F.col("key").bitwiseOR(F.lit(0)).alias("key")).distinct(), "failed")
        discard(found)
        if failed.isEmpty():
            return known
        rows = rows.join(failed.hint("merge"), "key", "left_semi")
    raise AssertionError


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row (what tells the rows of ``docs`` apart): one row per row of ``docs``."""
    texts = documents(docs, row_key(F.col("doc_id"), F.col("text")).alias("row"))
    signed = materialize(texts.mapInArrow(_signatures, SIGNATURE), "signatures")
    own = signed.filter("n_shingles > 0 and doc_id is not null")
    # A class goes by its smallest doc_id, or, where another class has the same one, by a hash.
    classes = own.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    shared = classes.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("of"))
    hashed = -F.pmod(F.xxhash64("content"), F.lit(1 << 62)) - 1
    classes = classes.join(shared.hint("merge"), F.col("doc_id") == F.col("of"), "left")
    classes = materialize(classes.select("content", "doc_id", F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(hashed).alias("id")), "classes")
    reps = own.join(classes.hint("merge"), ["content", "doc_id"]).dropDuplicates(["content", "doc_id"])
    reps = materialize(reps.select("id", "row", "n_shingles", "bands", "sketch", "parity"), "classes-signed")
    sketches = reps.select("id", "n_shingles", "sketch", "parity")
    # The pivot of a bucket is the member with most others in all its buckets.
    rows = reps.select(F.explode("bands").alias("key"), "id")
    buckets = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("key").bitwiseOR(F.lit(0)).alias("key"), "m")
    met = materialize(rows.join(buckets.hint("merge"), "key"), "met")
    weights = met.groupBy("id").agg(F.sum("m").alias("w")).select(F.col("id").bitwiseOR(F.lit(0)).alias("id"), "w")
    pivots = met.join(weights.hint("merge"), "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("pivot"))
    rows = materialize(met.select("key", "id").join(pivots.select(F.col("key").bitwiseOR(F.lit(0)).alias("key"), "pivot").hint("merge"), "key"), "buckets")
    discard(met)
    known = _components(rows, sketches, reps.select("id", "row"), texts.filter(F.col("doc_id").isNotNull()).select("row", "text"))
    named = known.join(classes.select(F.col("id").alias("node"), "doc_id").hint("merge"), "node")
    tops = named.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("top")).select(F.col("component").bitwiseOR(F.lit(0)).alias("component"), "top")
    tops = known.join(tops.hint("merge"), "component").select(F.col("node").bitwiseOR(F.lit(0)).alias("id"), "top")
    found = classes.join(tops.hint("merge"), "id", "left").select(
        F.concat("content", F.lit(b"")).alias("at"), F.coalesce("top.doc_id", "doc_id").alias("component_id"), F.coalesce(F.col("top.node") == F.col("id"), F.lit(True)).alias("first")
    )
    # Rows without a class have a place of their own, so that they don't meet in one task.
    held = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = signed.withColumn("at", F.when(held, F.col("content")).otherwise(F.encode("row", "utf-8"))).join(found.hint("merge"), "at", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.col("doc_id").eqNullSafe(component) & F.coalesce("first", F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest doc_id, in all its rows. Rows
    without a doc_id stay."""
    # Written, as it is read three times below: its plan has many joins, which would be planned and compiled for each.
    gone = materialize(near_duplicates(docs).filter("not kept").select(F.col("row").alias("key")), "gone")
    return without(docs, row_key(docs["doc_id"], docs["text"]), gone)
