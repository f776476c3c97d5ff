"""Fill-in-the-middle documents by rotating blocks in place, and the exact texts back from them.

A text's units are runs of A-Z and a-z, and every other character alone.  Two cuts, drawn from a hash of doc_id, part it
into prefix, middle and suffix.  The text is copied once, into a bytearray with room for the sentinels; ``P``prefix
``M``middle ``S``suffix stand there in order.  Putting the suffix before the middle (psm), or before prefix and middle (spm),
exchanges two neighbouring blocks of unequal length: each is reversed, then both together.  Reversals swap pieces of fixed
size from both ends, so nothing but that one array grows with the text.  The way back finds the sentinels, reverses
both blocks, exchanges them by the same three reversals and takes the sentinels out.

No row depends on another, so nothing is shuffled: Arrow batches in, Arrow batches out, a few MB at a time.

Null texts are empty; empty texts, texts that contain a sentinel, and those whose hash says so stay as they are (plain). A
null doc_id counts as the empty decimal. Rows that repeat get the same result each; a very long text is one array of its
own size; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cardloom.llm.common import documents, text_views
from cardloom.llm.words import slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of 100 documents so many are rewritten, and of 100 of those so many are spm.
REWRITTEN, SPM = 90, 20
#: Bytes that a reversal swaps at once.
SWAP = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where the units of texts begin that lie one after another in ``data``."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    edges = places[(places > 0) & (places < len(data))]
    begins[edges] = True
    return np.flatnonzero(begins)


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers that depend on the document's id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def reverse(view: np.ndarray, begin: int, end: int) -> None:
    """Reverses a stretch of bytes in place."""
    while end - begin > 1:
        k = min(SWAP, (end - begin) // 2)
        left = view[begin : begin + k].copy()
        view[begin : begin + k] = view[end - k : end][::-1]
        view[end - k : end] = left[::-1]
        begin, end = begin + k, end - k


def exchange(view: np.ndarray, begin: int, middle: int, end: int) -> None:
    """Exchanges the neighbouring blocks [begin, middle) and [middle, end) by three reversals."""
    reverse(view, begin, middle)
    reverse(view, middle, end)
    reverse(view, begin, end)


def rewrite(text: bytes, first: int, second: int, form: str) -> bytearray:
    """A text that is cut at two places, in the given form."""
    out = bytearray(len(text) + 9)
    a, b = 3 + first, 6 + second  # where the middle's and the suffix's sentinels stand before the exchange
    out[0:3], out[3:a], out[a : a + 3] = PREFIX, text[:first], MIDDLE
    out[a + 3 : b], out[b : b + 3], out[b + 3 :] = text[first:second], SUFFIX, text[second:]
    exchange(np.frombuffer(out, np.uint8), 0 if form == "spm" else a, b, len(out))
    return out


def restore(output: bytes, form: str) -> bytes:
    """The text that was rewritten."""
    if form == "plain":
        return output
    out = bytearray(output)
    at = out.find(SUFFIX)
    to = out.find(PREFIX if form == "spm" else MIDDLE, at)
    exchange(np.frombuffer(out, np.uint8), at, to, len(out))
    suffix = len(out) - (to - at)
    middle = out.find(MIDDLE)
    del out[suffix : suffix + 3], out[middle : middle + 3], out[0:3]
    return bytes(out)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _rewritten(seed: int, rewritten: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = text_views(batch)
            ids = batch.column(0).to_pylist()
            for lo, hi in slices(places):
                base, own = int(places[lo]), data[places[lo] : places[hi]]
                at = places[lo : hi + 1] - base
                starts = unit_starts(own, at)
                of = np.searchsorted(starts, at).tolist()
                characters = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                raw, rows = own.tobytes(), []
                for k, (begin, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    text, n = raw[begin:end], of[k + 1] - of[k]
                    h1, h2, h3, h4 = draws(ids[lo + k], seed)
                    if not text or h3 % 100 >= rewritten or PREFIX in text or SUFFIX in text or MIDDLE in text:
                        rows.append((ids[lo + k], n, "plain", None, None, text))
                        continue
                    first, second = (int(starts[of[k] + u]) if u < n else end for u in sorted((h1 % (n + 1), h2 % (n + 1))))
                    form = "spm" if h4 % 100 < spm else "psm"
                    sizes = (int(characters[y] - characters[x]) for x, y in ((begin, first), (first, second)))
                    rows.append((ids[lo + k], n, form, *sizes, bytes(rewrite(text, first - begin, second - begin, form))))
                ids_, n_, form_, prefix_, middle_, text_ = zip(*rows, strict=True)
                longs = [pa.array(x, pa.int64()) for x in (ids_, n_, prefix_, middle_)]
                columns = [*longs[:2], pa.array(form_, pa.string()), *longs[2:], _strings(list(text_))]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MADE.split(", ")])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rewritten: int = REWRITTEN, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null: plain) and output: one row per row of ``docs``."""
    return documents(docs).mapInArrow(_rewritten(seed, rewritten, spm), MADE)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, places = text_views(batch, "output")
        forms = batch.column(batch.schema.get_field_index("form")).to_pylist()
        for lo, hi in slices(places):
            raw, base = data[places[lo] : places[hi]].tobytes(), int(places[lo])
            texts = [restore(raw[a - base : b - base], form) for a, b, form in zip(places[lo:hi].tolist(), places[lo + 1 : hi + 1].tolist(), forms[lo:hi], strict=True)]
            yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], _strings(texts)], [*batch.schema.names, "restored"])


def restore_texts(made: DataFrame) -> DataFrame:
    """Adds restored: the text that ``output`` was made of, from output and form alone."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(_restored, f"{kinds}, restored string")
