"""Repeated passages of words, removed where they aren't first, by suffix automata over shards of the reference text.

A window of ``WINDOW`` words goes if the same words start earlier: in a document with a smaller doc_id, or earlier in the
same one.  The reference is the corpus itself, so a shard must hold all that can equal what streams past it:

1. Each window names an anchor: of the runs of ``GRAM`` words in it, the one whose hash is least.  Equal windows name
   equal anchors.  A scan counts the anchors of all texts; only those seen twice can lie in repeated windows, and a bitmap
   of fixed size tells the second scan which these are (and a few more, which costs only work).
2. The second scan puts out segments: the words of neighbouring windows with one anchor, 30 at most.  Equal segments are
   one row, combined before the shuffle, with the earliest place.  A segment found later than there goes whole.
3. Anchors with more than ``HOT`` different segments (a common line in very many surroundings) are cut further, into
   single windows dealt by their own words, which bounds every group.
4. Sorted by anchor, groups fill shards of ``SHARD`` words.  A shard's segments, in order of place, make one suffix
   automaton, whose states know where their words first end; then they stream past it, and the matching statistics at each
   word give the longest match that ends there.  If it has the window's length, its suffix of that length has a state, and
   if that one was first seen at an earlier place, the window goes.  Groups of a single segment need no automaton: no two
   windows of one segment are equal, or they would have named different anchors.
5. The spans of words that go are gathered by document, and the documents that lose words meet them in one join.

An automaton lives where its shard was dealt, and isn't sent to all tasks: as the reference is the corpus, every shard's
automaton in every task would be a cross join.

Null texts have no words. A null doc_id is smaller than any other; rows that share a doc_id are one document, in which
windows with the same start come first together and all stay, so rows that repeat have equal results. A very long text is
one row of many short segments; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import bit_filter, discard, documents, in_filter, materialize, text_views, with_filter
from cardloom.llm.words import mix, random_numbers, slices, word_hashes, word_spans

WINDOW, GRAM = 20, 10
HOT = 2048
SHARD = 1 << 17
#: Bits of the filter of repeated anchors: 16 MB in every task, whatever the input's size.
ANCHOR_BITS = 1 << 27

_PLACE = random_numbers(31, WINDOW) | np.uint64(1)
_FIRST = -(1 << 63)


def anchors_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window over hashed words: the least hash of its grams, and the word at which the first such gram starts."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams += words[k : k + len(grams)] * _PLACE[k]
    grams = mix(grams)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - gram + 1):
        less = grams[k : k + n] < best
        np.copyto(best, grams[k : k + n], where=less)
        at[less] = k
    return best, at + np.arange(n)


def _windows(batch: pa.RecordBatch, window: int, gram: int):
    """For each slice of a batch's texts: its rows, bytes, words, and the windows that lie in one text with their anchors."""
    data, places = text_views(batch)
    for lo, hi in slices(places):
        own = data[places[lo] : places[hi]]
        starts, ends, of = word_spans(own, places[lo : hi + 1] - places[lo])
        if len(starts) < window:
            continue
        best, at = anchors_of(word_hashes(own, starts, ends), window, gram)
        text = np.repeat(np.arange(lo, hi), np.diff(of))
        whole = np.flatnonzero(text[: len(best)] == text[window - 1 :])
        yield lo, own, starts, ends, of, text, whole, best[whole], at[whole]


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, best, at in _windows(batch, window, gram):
                found, times = np.unique(best[np.unique(at, return_index=True)[1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["anchor", "n"])

    return run


def _segments(window: int, gram: int, held):
    """Segments around anchors that the filter knows. The words of one are joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held.value, np.uint8)
        bits = np.uint64(8 * len(bitmap) - 1)
        for batch in batches:
            ids, rows = batch.column(0), batch.column(2).to_numpy()
            for lo, own, starts, ends, of, text, whole, best, at in _windows(batch, window, gram):
                place = best & bits
                hit = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                whole, best, at = whole[hit], best[hit], at[hit]
                if not len(whole):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]))
                last = np.concatenate([new[1:], [len(whole)]]) - 1
                begin, end, of_row = whole[new], whole[last] + window, text[whole[new]]
                # Words one after another with a space behind each.
                sizes = ends - starts
                after = np.cumsum(sizes + 1)
                joined = np.full(int(after[-1]), 0x20, np.uint8)
                inside = np.repeat(starts - (after - sizes - 1), sizes)
                spots = np.repeat(after - sizes - 1, sizes) + np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                joined[spots] = own[spots + inside]
                raw = joined.tobytes()
                texts = [raw[a:b] for a, b in zip((after - sizes - 1)[begin].tolist(), (after - 1)[end - 1].tolist(), strict=True)]
                columns = [
                    pa.array(best[new].view(np.int64)), pa.array(texts, pa.binary()).view(pa.string()), ids.take(pa.array(of_row)), pa.array(rows[of_row]),
                    pa.array((begin - of[of_row - lo]).astype(np.int32)), pa.array((end - begin).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "words", "doc_id", "row", "start", "n"])

    return run


class SuffixAutomaton:
    """All runs of words of the texts that were added, each with the place at which it first ends."""

    def __init__(self) -> None:
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]

    def add(self, words: list[str], place: int) -> None:
        """One text, whose words have the places ``place``, ``place`` + 1 and so on; larger ones than all before."""
        last = 0
        for k, word in enumerate(words):
            last = self._extend(last, word, place + k)

    def _extend(self, last: int, word: str, place: int) -> int:
        next_, link, length, first = self.next, self.link, self.length, self.first
        if word in next_[last]:
            q = next_[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = len(next_)
        next_.append({})
        length.append(length[last] + 1)
        first.append(place)
        link.append(0)
        p = last
        while p >= 0 and word not in next_[p]:
            next_[p][word] = new
            p = link[p]
        if p >= 0:
            q = next_[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: str, q: int) -> int:
        next_, link, length, first = self.next, self.link, self.length, self.first
        new = len(next_)
        next_.append(next_[q].copy())
        length.append(length[p] + 1)
        first.append(first[q])
        link.append(link[q])
        link[q] = new
        while p >= 0 and next_[p].get(word) == q:
            next_[p][word] = new
            p = link[p]
        return new

    def first_ends(self, words: list[str], window: int) -> Iterator[int]:
        """For each word from the ``window``-th on: where the window that ends with it first ends (-1: nowhere)."""
        next_, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for k, word in enumerate(words):
            while state and word not in next_[state]:
                state = link[state]
                matched = length[state]
            if word in next_[state]:
                state = next_[state][word]
                matched += 1
            while state and length[link[state]] >= window:  # the state of the window itself; longer matches aren't wanted
                state = link[state]
                matched = length[state]
            if k >= window - 1:
                yield first[state] if matched >= window else -1


def spans_of(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal stretches of words that windows with these (ascending) starts cover."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _judged(window: int, shard: int):
    """Different segments in order of their group, to those that hold anything to remove: the spans of words that start
    earlier elsewhere."""

    def flush(groups: list[list[tuple]]) -> Iterator[tuple]:
        rows = sorted((r for g in groups if len(g) > 1 for r in g), key=lambda r: (r[2], r[3]))
        automaton, places, at = SuffixAutomaton(), [], 0
        for _, words, doc, start, _ in rows:
            automaton.add(words.split(" "), at)
            places.append((at, doc, start))
            at += words.count(" ") + 1
        begins = np.array([p[0] for p in places])
        for group, words, doc, start, times in rows:
            gone = []
            for k, end in enumerate(automaton.first_ends(words.split(" "), window)):
                begin, other, its = places[int(np.searchsorted(begins, end, "right")) - 1]
                if (other, its + end - begin - window + 1) < (doc, start + k):
                    gone.append(k)
            if gone or times > 1:
                yield group, words, doc, start, spans_of(gone, window)
        for g in groups:
            if len(g) == 1 and g[0][4] > 1:
                yield *g[0][:4], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, size = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            spans = [[{"begin": a, "end": b} for a, b in x] for x in columns[4]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns[:4], spans], kinds, strict=True)], ["grp", "words", "doc_id", "start", "spans"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not groups or groups[-1][0][0] != row[0]:
                    if size >= shard:
                        yield batch_of(list(flush(groups)))
                        groups, size = [], 0
                    groups.append([])
                groups[-1].append(row)
                size += row[1].count(" ") + 1
        if groups:
            yield batch_of(list(flush(groups)))

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans of words that go, to what stays."""
    for batch in batches:
        data, places = text_views(batch)
        spans = batch.column(batch.schema.get_field_index("spans"))
        for lo, hi in slices(places):
            raw, base, out = data[places[lo] : places[hi]].tobytes(), int(places[lo]), []
            for k in range(lo, hi):
                words = raw[places[k] - base : places[k + 1] - base].split()
                going = sorted((x["begin"], x["end"]) for x in spans[k].as_py() or ())
                kept, merged, at = [], [], 0
                for a, b in going:
                    kept += words[at:a]
                    if b > at:
                        merged = [*merged[:-1], (merged[-1][0], b)] if merged and a <= at else [*merged, (a, b)]
                    at = max(at, b)
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept), [{"begin": a, "end": b} for a, b in merged]))
            n, gone, texts, removed = zip(*out, strict=True)
            kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).view(pa.string()), pa.array(removed, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def _anchor_filter(anchors: DataFrame, bits: int) -> bytearray:
    """A bitmap of the anchors seen twice or more: its size is fixed, and of its rows of 4 KB only set ones reach the driver."""
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    place = F.col("anchor").bitwiseAND(F.lit(bits - 1)) + 1  # buckets and places are counted from 1
    rows = twice.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    out = bytearray(bits // 8)
    for bucket, bitmap in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place"))).toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = bitmap
    return out


def repeated_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, bits: int = ANCHOR_BITS) -> DataFrame:
    """(doc_id, text, row) to (doc_id, row, spans): the words of each document that go, as [begin, end) of word numbers."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(bytes(_anchor_filter(texts.mapInArrow(_anchors(window, gram), "anchor long, n long"), bits)))
    found = texts.mapInArrow(_segments(window, gram, held), "anchor long, words string, doc_id long, row long, start int, n int")
    found = materialize(found, "segments")
    many = found.select("anchor", F.xxhash64("words").alias("h")).distinct().groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    many = materialize(many.select("anchor"), "hot")
    found = found.withColumn("cut", in_filter(many, "anchor"))
    parts = F.split("words", " ")
    single = F.transform(F.sequence(F.lit(0), F.col("n") - window), lambda k: F.struct(F.array_join(F.slice(parts, k + 1, window), " ").alias("words"), k.alias("k")))
    whole = found.filter("not cut").select(F.col("anchor").alias("grp"), "words", "doc_id", "row", "start", "n")
    cut = found.filter("cut").select(F.explode(single).alias("s"), "doc_id", "row", "start")
    cut = cut.select(F.xxhash64("s.words").alias("grp"), "s.words", "doc_id", "row", (F.col("start") + F.col("s.k")).alias("start"), F.lit(window).alias("n"))
    every = whole.unionByName(cut)
    place = F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc_id"), "start")
    different = every.groupBy("grp", "words").agg(F.min(place).alias("p"), F.count("*").alias("times"))
    different = different.select("grp", "words", "p.doc_id", "p.start", "times").repartition("grp").sortWithinPartitions("grp")
    judged = different.mapInArrow(_judged(window, shard), "grp long, words string, doc_id long, start int, spans array<struct<begin:int,end:int>>")
    judged = materialize(judged.select("grp", F.xxhash64("words").alias("h"), F.col("doc_id").alias("at_doc"), F.col("start").alias("at_start"), "spans"), "judged")
    first = (F.coalesce("doc_id", F.lit(_FIRST)) == F.col("at_doc")) & (F.col("start") == F.col("at_start"))
    here = F.transform("spans", lambda x: F.struct((x["begin"] + F.col("start")).alias("begin"), (x["end"] + F.col("start")).alias("end")))
    all_ = F.array(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("n")).alias("end")))
    met = every.select("grp", F.xxhash64("words").alias("h"), "doc_id", "row", "start", "n").join(judged.hint("merge"), ["grp", "h"])
    gone = met.select("doc_id", "row", F.explode(F.when(first, here).otherwise(all_)).alias("span"))
    spans = materialize(gone.groupBy("doc_id", "row").agg(F.collect_set("span").alias("spans")), "spans")
    discard(found, judged, many)
    return spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, **more) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words that stay, joined by a space), removed (stretches of word numbers): one
    row per row of ``docs``."""
    texts = documents(docs, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("row"))
    spans = repeated_spans(texts, window, **more)
    id_: Column = F.coalesce(F.col("doc_id"), F.lit(_FIRST))
    marked = with_filter(texts, bit_filter(spans, id_, "row"), id_, "row", flag="losing")
    none = F.array().cast("array<struct<begin:int,end:int>>").alias("spans")
    alone = marked.filter("not losing").select("doc_id", "text", none)
    losing = marked.filter("losing").select(id_.alias("id"), "doc_id", "text", "row")
    losing = losing.join(spans.select(id_.alias("id"), "row", "spans").hint("merge"), ["id", "row"], "left").select("doc_id", "text", "spans")
    return alone.unionByName(losing).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<begin:int,end:int>>")
