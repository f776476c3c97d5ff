"""Families of near copies, whose members lie on both sides of the similarity, against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cardloom.llm import components as stars
from cardloom.llm import near_dedup
from cardloom.llm.components import components


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_force(texts: dict[int, str]) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in texts.items()}
    of = {d: d for d in texts}

    def root(d: int) -> int:
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {d: root(d) for d in ids}


def family(r: random.Random, base: list[str], n: int, edits: int, drift: bool) -> list[str]:
    out, now = [], base
    for _ in range(n):
        words = list(now)
        for at in r.sample(range(len(words)), edits):
            words[at] = f"w{r.randrange(10**9)}"
        if drift:
            now = words
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [16, 1024])
def test_families(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    r = random.Random(tile)
    texts = []
    for edits in (2, 3, 4, 5, 6):
        base = [f"b{r.randrange(10**6)}" for _ in range(150)]
        texts += family(r, base, 60, edits, False) + family(r, base, 40, edits, True)
    r.shuffle(texts)
    rows = dict(enumerate(texts))
    found = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert found == brute_force(rows)


def test_tile_emits_a_forest():
    r = random.Random(5)
    base = [f"b{r.randrange(10**6)}" for _ in range(300)]
    import pyarrow as pa

    rows = []
    for i, t in enumerate(family(r, base, 200, 3, False)):
        s = np.array(sorted({hash(x) & (2**64 - 1) for x in shingles(t)}), np.uint64)
        m = near_dedup.minhash(s)
        for side in (0, 1):
            rows.append({"key": 7, "id": i, "comp": i, "n_shingles": len(s), "side": side, "minor": True, "sketch": near_dedup.odd_sketch(m).tolist(), "parity": near_dedup.parity_sketch(s).tobytes()})
    out = near_dedup._tile(0)(pa.Table.from_pylist(rows)).to_pylist()
    assert len(out) == 199 and all(x["more"] and x["pivot"] < x["id"] for x in out)
    assert len(near_dedup._tile(1)(pa.Table.from_pylist(rows))) == 199 + 400
    whole = near_dedup._tile(1000)(pa.Table.from_pylist(rows)).to_pylist()
    assert len(whole) > 10_000 and not any(x["more"] for x in whole)


def test_components_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.component for r in components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(path, rounds=2)


def test_rows_of_one_doc_id(spark):
    r = random.Random(3)
    a, b = (" ".join(f"b{r.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    c = " ".join(f"b{r.randrange(10**6)}" for _ in range(60))
    rows = [(3, a), (5, a + " end"), (5, b), (None, a), (None, b), (7, None), (7, a), (6, c), (6, c + " end"), (5, b)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(map(tuple, kept), key=str)
    assert kept in [sorted([(3, a), (5, b), (5, b), (None, a), (None, b), (7, None), (6, x)], key=str) for x in (c, c + " end")]


def test_plans_of_joins_are_made_once(spark, monkeypatch):
    """A round of stars, and what drops copies, have each join once: plans that double with each use fill the driver."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    step = stars._round(edges)
    assert {(r.a, r.b) for r in step.collect()} == {(1, 2), (1, 3), (5, 6)}
    assert step._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    left = near_dedup.drop_near_duplicates(spark.createDataFrame([(k, f"a b c d e f g h {k % 2 and 'x'}") for k in range(4)], "doc_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {0, 1}
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
