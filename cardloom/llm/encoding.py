"""Exact byte-level BPE encoding for use inside tasks.

``tokenizers`` is the authority.  Where a tokenizer's ids are in merge order, its own file also gives the merge ranks for
the rank-based encoder (tiktoken), which needs a seventh of the time; it takes the parts of a text whose characters have
one class in every Unicode version, and ``tokenizers`` itself all else: other characters, texts holding an added token,
tokenizers with another pre-tokenizer.  Parts are cut where the byte-level pre-tokenizer always cuts, too: before a space
that a non-space follows, or that follows a non-space.  Tests hold both encoders equal.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Boundaries that the byte-level pre-tokenizer never crosses.
_SAFE_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
#: Characters whose class (letter, digit, space, other) is the same in every Unicode version.
_NOT_PLAIN = re.compile(r"[^\x00-~À-ÖØ-öø-ʯ]")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode_bytes`` gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocab_size = self.tokenizer.get_vocab_size()
        before = spec.get("pre_tokenizer") or {}
        self.fast = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self.added = tuple(x["content"] for x in spec.get("added_tokens", ()) if x["content"])
        self.token_bytes = self._bytes_of_ids(spec)
        self.ranked = self._by_rank(spec) if self.fast else None

    def _bytes_of_ids(self, spec: dict) -> list[bytes]:
        """What each id decodes to; added tokens stand for their own text."""
        back = {c: b for b, c in byte_characters().items()}
        out = [b""] * self.vocab_size
        for token, i in spec["model"]["vocab"].items() if self.fast else ():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for x in spec.get("added_tokens", ()):
            out[x["id"]] = x["content"].encode()
        return out

    def _by_rank(self, spec: dict):
        """The same merges for the faster rank-based encoder, where ids are in merge order; else None."""
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        ids = [vocab.get("".join(p), -1) for p in pairs]
        characters = byte_characters()
        if not ids or ids != list(range(ids[0], ids[0] + len(ids))) or any(vocab.get(c, ids[0]) >= ids[0] for c in characters.values()):
            return None
        import tiktoken

        kept = {*ids, *(vocab[c] for c in characters.values())}
        ranks = {self.token_bytes[i]: i for i in sorted(kept)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _runs(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text in parts that end at safe cuts, each plain or not."""
        for plain, pieces in groupby(_SAFE_CUT.split(text), lambda p: not _NOT_PLAIN.search(p)):
            yield plain, "".join(pieces)

    def encode_bytes(self, text: str) -> bytes:
        if self.ranked is None or any(a in text for a in self.added):
            return self._slow(text)
        if text.isascii() or not _NOT_PLAIN.search(text):
            return array("I", self.ranked.encode_ordinary(text)).tobytes()
        return b"".join(array("I", self.ranked.encode_ordinary(p)).tobytes() if plain else self._slow(p) for plain, p in self._runs(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def decode_bytes(self, ids: bytes) -> str:
        """As ``decode(ids, skip_special_tokens=False)``: bytes joined, what isn't UTF-8 replaced."""
        if not self.fast:
            return self.tokenizer.decode(list(memoryview(ids).cast("I")), skip_special_tokens=False)
        return b"".join(map(self.token_bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")

    def safe_cuts(self, text: str) -> list[int]:
        """Places inside the text before which no token reaches; none where that can't be told."""
        if not self.fast or any(a in text for a in self.added):
            return []
        return [m.start() for m in _SAFE_CUT.finditer(text) if 0 < m.start() < len(text)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
