"""Words, word hashes and shingle sets of whole Arrow batches, in numpy: no Python object per word.

Words are maximal runs of bytes other than the six ASCII spaces; that is the same over UTF-8 bytes and over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
SHINGLE = 5
#: Bytes that are handled at once (one longer text alone may exceed it).
SLICE = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)


def random_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, np.uint64)


_BYTE = random_numbers(11, 256)
_PLACE = random_numbers(13, SHINGLE) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit of 64-bit numbers over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def table(p: int) -> np.ndarray:
        factors = np.full(size, p, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    return table(_P), table(_P_INVERSE)


def slices(places: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes."""
    n, at = len(places) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(places, places[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_spans(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end in ``data``, and which words (first, one past the last) each text has."""
    inside = ~SPACES[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = places[(places > 0) & (places < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, places)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = 1 << max(20, int(len(data)).bit_length())
    powers, inverse = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray) -> np.ndarray:
    """Of each five words in a row, over all texts: those that cross from one text to the next are for the caller to skip."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += words[k : k + n] * _PLACE[k]
    return mix(out)


def sequence_hash(words: np.ndarray, seed: int) -> int:
    """Of any number of words in order."""
    powers = _powers(1 << max(20, int(len(words)).bit_length()))[0]
    x = (mix(words ^ np.uint64(seed)) * powers[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
    return int(mix(np.array([x], np.uint64))[0])


def shingle_sets(data: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its words' hashes and its distinct shingles, sorted; A-Z are lower-cased. Fewer than five words are
    one shingle; no words, none."""
    for lo, hi in slices(places):
        own = LOWERED[data[places[lo] : places[hi]]]
        starts, ends, of = word_spans(own, places[lo : hi + 1] - places[lo])
        words = word_hashes(own, starts, ends) if len(own) else np.zeros(0, np.uint64)
        windows = window_hashes(words)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield words[a:b], np.unique(windows[a : b - SHINGLE + 1])
            elif b > a:
                yield words[a:b], np.array([sequence_hash(words[a:b], 17)], np.uint64)
            else:
                yield words[a:b], np.zeros(0, np.uint64)
