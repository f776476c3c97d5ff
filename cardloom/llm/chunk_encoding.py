"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash over the last 32 bytes has its low bits zero, so a passage that two documents share
falls into the same chunks in both.  Chunks are known by 128-bit fingerprints:

1. every document's chunk fingerprints are written out and counted, once for each different text, with the number of its
   rows; those in two or more documents are shared, and the smallest doc_id that holds one owns it;
2. the owners' documents encode each shared chunk once, and its ids go to all texts that hold it; a document that
   shares nothing is encoded whole, where it is read (a filter of fixed size tells most of them apart without a join);
3. of the rest, each takes the ids of its shared chunks as they are, encodes its own, and repairs the joins: from the last
   place in a chunk that no token can cross to the first such place in the next, the text is encoded anew.  Both ends
   are places where independent and joint encoding agree exactly; a chunk without such a place is re-encoded whole,
   with its neighbours, until one is reached.

Texts are known by 128 bits of theirs, so rows that repeat, and copies under other doc_ids, are one text with one list of
known chunks, whatever their number; of an owner's rows that repeat one encodes.  The hot chunk is one row until the last
join, whose sides are plain shuffles that adaptive execution can split.  Null texts are empty (no ids); an empty table gives
no rows; a null doc_id is smaller than any other, and documents that repeat a doc_id get their own ids each; a very long
text is one row of many chunks, of which the shared ones are encoded elsewhere; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import bit_filter, documents, materialize, text_views, with_filter
from cardloom.llm.encoding import Encoder, encoder

#: A cut every so many bytes on average (a power of two); none before the least, one at the most.
CHUNK, LEAST, MOST = 1024, 256, 8192
WINDOW = 32
#: What tells texts apart.
TEXT = ("text_a", "text_b")
_FIRST_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")


def _gear() -> np.ndarray:
    """A fixed random 32-bit number for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


GEAR = _gear()


def chunk_ends(data: np.ndarray, places: np.ndarray) -> list[list[int]]:
    """For texts that lie one after another in ``data`` (UTF-8): where each one's chunks end, from its own start."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # h[i] = sum of gear[data[i - j]] << j over a window twice as long
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    found = np.flatnonzero(h >> np.uint32(32 - CHUNK.bit_length() + 1) == 0) + 1
    inside = (data & 0xC0) == 0x80  # not the first byte of a character
    out = []
    first = np.searchsorted(found, places[:-1], "right").tolist()
    last = np.searchsorted(found, places[1:], "left").tolist()
    cuts = found.tolist()
    for k, (begin, end) in enumerate(zip(places[:-1].tolist(), places[1:].tolist(), strict=True)):
        ends, at = [], begin
        for c in [*cuts[first[k] : last[k]], end]:
            if c - at < LEAST and c != end or c <= at:
                continue
            while c - at > MOST:
                ends.append(at + MOST)
                at += MOST
            ends.append(c)
            at = c
        fixed = []
        for e in ends:
            while e < end and inside[e]:
                e += 1
            if e - begin > (fixed[-1] if fixed else 0):
                fixed.append(e - begin)
        out.append(fixed)
    return out


def fingerprint(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, list[int]]]:
    data, places = text_views(batch)
    raw = data.tobytes()
    for doc_id, begin, end, ends in zip(batch.column(0).to_pylist(), places[:-1].tolist(), places[1:].tolist(), chunk_ends(data, places), strict=True):
        yield doc_id, raw[begin:end], ends


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, prints = [], []
        for k, (_, raw, ends) in enumerate(_chunks(batch)):
            own = {fingerprint(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)}
            prints += own
            rows += [k] * len(own)
        of = pa.array(rows, pa.int64())
        columns = [batch.column(batch.schema.get_field_index(n)).take(of) for n in ("doc_id", *TEXT)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.binary())], ["doc_id", *TEXT, "print"])


def _last_cut(enc: Encoder, text: str) -> int:
    """The last place in the text that no token crosses, or 0."""
    at = text.rfind(" ")
    while at > 0:
        if not text[at - 1].isspace() or at + 1 < len(text) and not text[at + 1].isspace():
            return at
        at = text.rfind(" ", 0, at)
    return 0


def split_chunk(enc: Encoder, text: str) -> tuple[int, int]:
    """The first and last place in a chunk that no token crosses; (0, 0) where there is none."""
    if enc.ranked is None or any(a in text for a in enc.added):
        return 0, 0
    first = _FIRST_CUT.search(text, 1)
    last = _last_cut(enc, text)
    return (first.start(), last) if first and last >= first.start() else (0, 0)


def encode_chunk(enc: Encoder, text: str) -> tuple[bytes, int, int]:
    """A chunk's ids between its first and last such place, and the two places. Without one, no ids."""
    first, last = split_chunk(enc, text)
    return enc.encode_bytes(text[first:last]) if last else b"", first, last


def join_chunks(enc: Encoder, chunks: Iterator[tuple[str, tuple[bytes, int, int]]]) -> bytes:
    """The ids of a whole text from its chunks: the inner ids as they are, each join encoded anew."""
    out, open_text = [], []
    for text, (ids, first, last) in chunks:
        if not last:  # no place of agreement: the join reaches over the whole chunk
            open_text.append(text)
            continue
        open_text.append(text[:first])
        out += [enc.encode_bytes("".join(open_text)), ids]
        open_text = [text[last:]]
    out.append(enc.encode_bytes("".join(open_text)))
    return b"".join(out)


def narrow(ids: bytes) -> bytes:
    """32-bit ids in three bytes each."""
    return np.frombuffer(ids, np.uint8).reshape(-1, 4)[:, :3].tobytes()


def widen(ids: bytes) -> bytes:
    out = np.zeros((len(ids) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(ids, np.uint8).reshape(-1, 3)
    return out.tobytes()


def _shared_encoder(tokenizer: str):
    """(doc_id, text, prints that it owns) to (print, ids, first, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for (_, raw, ends), owned in zip(_chunks(batch), batch.column("prints").to_pylist(), strict=True):
                wanted = set(owned)
                for a, b in zip([0, *ends], ends, strict=False):
                    if (p := fingerprint(raw[a:b])) in wanted:
                        wanted.discard(p)
                        ids, first, last = encode_chunk(enc, raw[a:b].decode())
                        rows.append((p, narrow(ids), first, last))
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["print", "inner_ids", "first", "last"])

    return run


def _document_encoder(tokenizer: str, then: Callable, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for (doc_id, raw, ends), known in zip(_chunks(batch), batch.column("known").to_pylist(), strict=True):
                have = {x["print"]: (widen(x["inner_ids"]), x["first"], x["last"]) for x in known or ()}

                def parts(raw=raw, ends=ends, have=have):
                    for a, b in zip([0, *ends], ends, strict=False):
                        text = raw[a:b].decode()
                        yield text, (have.get(fingerprint(raw[a:b])) if have else None) or encode_chunk(enc, text)

                whole = raw.decode() if enc.added and any(a.encode() in raw for a in enc.added) else None
                ids = join_chunks(enc, parts()) if whole is None else enc.encode_bytes(whole)
                rows.append((doc_id, *then(enc, ids)))
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def _whole_encoder(tokenizer: str, then: Callable, kinds: pa.Schema):
    """For documents that share no chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = [(d, *then(enc, enc.encode_bytes(t.as_py()))) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return run


def ids_and_text(enc: Encoder, ids: bytes) -> tuple:
    return len(ids) // 4, ids, enc.decode_bytes(ids)


IDS_AND_TEXT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def digests(enc: Encoder, ids: bytes) -> tuple:
    """Of the ids and of what they decode to, as the contract has them."""
    view = memoryview(ids).cast("I")
    text = ",".join(map(str, view))
    return len(view), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids).encode()).hexdigest()


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _ddl(kinds: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in kinds)


def encode_with_reuse(docs: DataFrame, tokenizer: str, then: Callable = ids_and_text, kinds: pa.Schema = IDS_AND_TEXT) -> DataFrame:
    """doc_id, and what ``then`` makes of the encoder and a document's ids (32-bit little-endian): by default n_tokens,
    ids and decoded text."""
    keys = F.xxhash64(F.coalesce("text", F.lit(""))).alias(TEXT[0]), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias(TEXT[1])
    texts = documents(docs, *keys)
    each = texts.mapInArrow(_fingerprints, "doc_id long, text_a long, text_b long, print binary")
    first = F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc")
    held = materialize(each.groupBy(*TEXT, "print").agg(F.count("*").alias("n"), first), "prints")
    shared = held.groupBy("print").agg(F.sum("n").alias("n"), F.min(F.struct("doc", *TEXT)).alias("owner")).filter("n > 1")
    shared = materialize(shared.select("print", "owner.*"), "shared")
    # Merge joins throughout: the same plan at every size, with two plain shuffles that can be split where a key is hot.
    holds = held.join(shared.select("print").hint("merge"), "print", "left_semi")
    texts = with_filter(texts, bit_filter(holds, *TEXT), *TEXT, flag="sharing")
    alone, sharing = texts.filter("not sharing").drop("sharing"), texts.filter("sharing").drop("sharing")
    owned = shared.groupBy("doc", *TEXT).agg(F.collect_list("print").alias("prints"))
    owners = sharing.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63))))
    owners = with_filter(owners, bit_filter(shared, "doc", *TEXT), "doc", *TEXT, flag="owning").filter("owning").select("doc", "text", *TEXT)
    owners = owners.dropDuplicates(["doc", *TEXT])  # rows that repeat meet before the shuffle
    once = owners.join(owned.hint("merge"), ["doc", *TEXT]).select("doc", "text", "prints")
    once = materialize(once.mapInArrow(_shared_encoder(tokenizer), "print binary, inner_ids binary, first int, last int"), "chunks")
    known = held.join(once.hint("merge"), "print").groupBy(*TEXT).agg(F.collect_list(F.struct("print", "inner_ids", "first", "last")).alias("known"))
    # Keys made anew have a shuffle of their own, so that the rows of a text that very many documents have can be split.
    again = [F.col(c).bitwiseOR(F.lit(0)).alias(c) for c in TEXT]
    known = known.select(*again, "known")
    run = _document_encoder(tokenizer, then, kinds)
    joined = sharing.join(known.hint("merge"), list(TEXT), "left").select("doc_id", "text", "known").mapInArrow(run, _ddl(kinds))
    return alone.mapInArrow(_whole_encoder(tokenizer, then, kinds), _ddl(kinds)).unionByName(joined)
