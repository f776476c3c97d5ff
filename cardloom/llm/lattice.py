"""A unigram subword lattice over words, in numpy: all words of a batch at once.

A word is its boundary mark and its characters; the pieces of an existing vocabulary that match between two places are
the lattice's arcs.  The forward recursion, in log space, sums the probabilities of all segmentations.  A character that
no piece stands for is spelled by the pieces of its UTF-8 bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from cardloom.llm.words import mix

MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20
#: Cells (words x length) that are handled at once.
CELLS = 1 << 16


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0xD1B54A32D192ED03))


class Pieces:
    """The pieces of a SentencePiece model that can stand in a word, and the slots of their hashes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        words = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
        words = [(p, s) for p, s in words if p and MARK not in p[1:] and s > -1e8]
        self.texts = [p for p, _ in words]
        self.n = len(words)
        #: Bytes follow the pieces.
        self.size = self.n + 256
        rank = np.array([-s for _, s in words])
        self.prior = np.concatenate([1 / (rank + 3), np.full(256, 1e-4)])
        self.prior /= self.prior.sum()
        self.longest = max(map(len, self.texts), default=1)
        self.keys = np.array([self._hash(p) for p in self.texts], np.uint64)
        slots = (self.keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        self.tables: list[np.ndarray] = []
        left = np.arange(self.n)
        while len(left):  # a slot's second piece goes to the second table, and so on
            table = np.full(1 << _SLOT_BITS, -1, np.int32)
            table[slots[left]] = left
            self.tables.append(table)
            left = left[table[slots[left]] != left]
        self.single = {ord(p) for p in self.texts if len(p) == 1}

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for v in _values(np.array([ord(c) for c in piece])):
            h = h * _P + v
        return h[0]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        slots = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        rest = np.arange(len(hashes))
        for table in self.tables:
            got = table[slots[rest]]
            there = got >= 0
            rest, got = rest[there], got[there]
            same = self.keys[got] == hashes[rest]
            out[rest[same]] = got[same]
            rest = rest[~same]
            if not len(rest):
                break
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _log_sum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(terms - safe[:, None]).sum(axis=1)) + safe


class Lattice:
    """Words of one length (in characters, without the mark) under log probabilities of pieces and bytes."""

    def __init__(self, vocabulary: Pieces, points: np.ndarray, log_p: np.ndarray):
        self.v, self.log_p = vocabulary, log_p
        n, self.length = points.shape[0], points.shape[1] + 1
        marked = np.concatenate([np.full((n, 1), ord(MARK), points.dtype), points], axis=1)
        value = _values(marked.ravel()).reshape(n, self.length)
        sums = np.zeros((self.length + 1, n), np.uint64)
        for j in range(self.length):
            sums[j + 1] = sums[j] * _P + value[:, j]
        self.longest = min(vocabulary.longest, self.length)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                power.append(power[-1] * _P)
        #: arc[k][i]: the piece of k + 1 characters from place i on.
        self.arc = []
        for k in range(1, self.longest + 1):
            h = sums[k:] - sums[: self.length - k + 1] * power[k]
            self.arc.append(vocabulary.find(h.ravel()).reshape(self.length - k + 1, n))
        self.score = [np.where(a >= 0, log_p[a], -np.inf) for a in self.arc]
        self.spelled = self._spell(marked)

    def _spell(self, marked: np.ndarray) -> list[tuple[int, np.ndarray, int]]:
        """Where single characters have no piece, the bytes' log probabilities take its place."""
        out = []
        if self.longest and (self.arc[0] < 0).any():
            for point in np.unique(marked.T[self.arc[0] < 0]).tolist():
                raw = chr(point).encode("utf-8", "surrogatepass")
                at = (marked.T == point) & (self.arc[0] < 0)
                self.score[0][at] = sum(self.log_p[self.v.n + b] for b in raw)
                out.append((point, at, raw))
        return out

    def forward(self) -> np.ndarray:
        """alpha[j]: the log probability of the first j characters."""
        n = self.score[0].shape[1]
        alpha = np.full((self.length + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, self.length + 1):
            most = min(j, self.longest)
            alpha[j] = _log_sum(np.stack([alpha[j - k] + self.score[k - 1][j - k] for k in range(1, most + 1)], axis=1))
        return alpha

    def expected(self, weights: np.ndarray) -> np.ndarray:
        """How often each piece and byte is expected, over all segmentations of the words, each so many times."""
        alpha = self.forward()
        n = alpha.shape[1]
        beta = np.full((self.length + 1, n), -np.inf)
        beta[self.length] = 0
        for i in range(self.length - 1, -1, -1):
            most = min(self.length - i, self.longest)
            beta[i] = _log_sum(np.stack([self.score[k - 1][i] + beta[i + k] for k in range(1, most + 1)], axis=1))
        total = np.zeros(self.v.size)
        whole = alpha[self.length]
        #: The log probability of all the words, each so many times.
        self.likelihood = float(whole @ weights)
        for k in range(1, self.longest + 1):
            share = np.exp(alpha[: self.length - k + 1] + self.score[k - 1] + beta[k:] - whole) * weights
            known = self.arc[k - 1] >= 0
            total += np.bincount(self.arc[k - 1][known], share[known], self.v.size)
            if k == 1:
                for _, at, raw in self.spelled:
                    amount = share[at].sum()
                    for b in raw:
                        total[self.v.n + b] += amount
        return total


def by_length(words: list[str]):
    """Indexes of words of one length, in parts of bounded size, and their code points."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        size = int(lengths[part[0]])
        step = max(1, CELLS // (size + 1))
        for at in range(0, len(part), step):
            some = part[at : at + step]
            text = "".join([words[i] for i in some.tolist()])
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
            yield some, points


def log_probabilities(vocabulary: Pieces, log_p: np.ndarray, words: list[str]) -> np.ndarray:
    """The natural log of each word's marginal probability."""
    out = np.zeros(len(words))
    for some, points in by_length(words):
        out[some] = Lattice(vocabulary, points, log_p).forward()[-1]
    return out


def expectation(vocabulary: Pieces, log_p: np.ndarray, words: list[str], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The expected number of each piece and byte in words that occur so many times, and the words' log probability."""
    out, likelihood = np.zeros(vocabulary.size), 0.0
    for some, points in by_length(words):
        lattice = Lattice(vocabulary, points, log_p)
        out += lattice.expected(weights[some])
        likelihood += lattice.likelihood
    return out, likelihood


def expected_counts(vocabulary: Pieces, log_p: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    return expectation(vocabulary, log_p, words, weights)[0]
