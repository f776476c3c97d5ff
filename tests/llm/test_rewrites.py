"""Fill-in-the-middle, repeated passages and the trie of conversations, each against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from cardloom.llm import fill_middle, prefix_trie, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
DOCS = "doc_id long, text string, row string, words string, spans long, form string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in rows], DOCS)


# --- fill in the middle


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_plain_version_and_comes_back(spark):
    r = random.Random(3)
    rows = [(d, "".join(r.choice(["a", "Bc", " ", "é", "日", "<", "P", ">", "\n", "😀", "\u0085"]) for _ in range(r.randrange(40)))) for d in range(300)]
    rows += [(None, "no id"), (None, None), (7, None), (8, ""), (9, "a<P>b"), (10, "word " * 100_000), (11, "x" * 200_000), (12, "é"), (12, "é")]
    made = fill_middle.restore_texts(fill_middle.fill_in_middle(frame(spark, rows))).collect()
    assert sorted((tuple(x)[:-1] for x in made), key=repr) == sorted((plain_middle(*x) for x in rows), key=repr)
    assert sorted((x.restored for x in made)) == sorted(t or "" for _, t in rows)
    assert {x.form for x in made} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table(spark):
    made = fill_middle.restore_texts(fill_middle.fill_in_middle(frame(spark, [])))
    assert made.collect() == [] and made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def test_exchange_by_reversals_over_blocks_larger_than_a_swap():
    data = np.random.default_rng(1).integers(0, 256, 3 * fill_middle.SWAP + 5, np.uint8)
    for begin, middle, end in ((0, 1, len(data)), (3, fill_middle.SWAP * 2 + 7, len(data) - 2), (5, 5, 9), (5, 9, 9)):
        view = data.copy()
        fill_middle.exchange(view, begin, middle, end)
        assert (view == np.concatenate([data[:begin], data[middle:end], data[begin:middle], data[end:]])).all()


# --- repeated passages


def plain_repeats(rows, n=20):
    place = lambda d, i: (d is not None, d or 0, i)
    first: dict = {}
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, place(d, i)), place(d, i))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < place(d, i):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def passages():
    r = random.Random(5)
    text = lambda n, kinds: " ".join(r.choice("abcdefghijklmnopqrstuvwxyz"[:kinds]) for _ in range(n))
    base, line = text(300, 20), text(17, 20)
    rows = [(1, base), (2, base), (3, text(50, 9) + " " + base[100:400] + "\n " + text(40, 9)), (None, base[50:300]), (None, text(30, 20) + "  " + base[20:200])]
    rows += [(5, None), (6, ""), (6, " \n"), (7, "a " * 500), (8, "a b c " * 100), (9, "b c a " * 60), (10, text(3000, 2)), (11, text(2000, 2)), (12, "é日 " * 25), (13, "x é日 " + "é日 " * 25)]
    rows += [(20 + i, text(25, 20) + " " + line + " " + text(25, 20)) for i in range(40)]  # one line in many surroundings
    return rows + [(200, base + " x")] * 200 + [(201, text(20, 20)), (202, text(19, 20)), (1, base[30:]), (1, text(40, 9))]


@pytest.mark.parametrize("more", [{}, {"hot": 3, "shard": 64, "bits": 1 << 15}])
def test_repeats_equal_plain_version(spark, passages, more):
    got = substring_dedup.remove_repeats(frame(spark, passages), **more).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_text) for x in got), key=repr) == plain_repeats(passages)
    assert all(sum(b - a for a, b in x.removed) == x.n_removed for x in got)


def test_repeats_of_an_empty_table(spark):
    out = substring_dedup.remove_repeats(frame(spark, []))
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "n_removed", "kept_text", "removed"]


def test_repeats_of_ten_thousand_equal_rows(spark):
    text = " ".join(f"w{k % 97}" for k in range(120))
    got = substring_dedup.remove_repeats(frame(spark, [(4, text)] * 10_000 + [(5, text)])).groupBy("doc_id", "n_removed").count().collect()
    want = {d: (m, c) for d, m, c in [(4, plain_repeats([(4, text)])[0][2], 10_000), (5, 120, 1)]}
    assert {x[0]: (x[1], x[2]) for x in got} == want


def test_automaton_knows_where_each_window_first_ends():
    r = random.Random(2)
    texts = [[r.choice("ab") for _ in range(r.randrange(1, 30))] for _ in range(40)]
    automaton, at, first = substring_dedup.SuffixAutomaton(), 0, {}
    for t in texts:
        automaton.add(t, at)
        for k in range(4, len(t)):
            first.setdefault(tuple(t[k - 4 : k + 1]), at + k)
        at += len(t)
    for t in [*texts, list("cabab"), list("ababc" * 3)]:
        assert list(automaton.first_ends(t, 5)) == [first.get(tuple(t[k - 4 : k + 1]), -1) for k in range(4, len(t))]


def test_windows_of_one_segment_differ():
    """What a group of a single segment rests on, over texts with short periods."""
    r = random.Random(8)
    for _ in range(200):
        words = np.array([hash(x) & 0xFFFF for x in (r.choices("ab", k=r.randrange(1, 9)) * 30)[:60]], np.uint64)
        _, at = substring_dedup.anchors_of(words, 20, 10)
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                assert at[a] != at[b] or (words[a : a + 20] != words[b : b + 20]).any()


# --- conversations


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    for v in own.values():
        v.sort()
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(x[2:] for x in own.get(c - int(math.fmod(c, 100)), [])[:h]) + tuple(x[2:] for x in v[h:])
    members, children, leaves, saved = defaultdict(set), defaultdict(set), {}, {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].add(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in children[p])
    ends = {p: ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))) for p, m in members.items()}
    rows = [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, m in members.items()]
    return sorted(rows, key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth string, path string, own string"


def turns(spark, rows):
    return spark.createDataFrame([(*x, "p", "q", "r") for x in rows], TURNS)


def test_trie_equals_plain_version(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", None]), r.choice(["a", "bb", None, "日本"])) for c in [*range(230), -50, -100, -7] for t in [None] * (c % 2) + list(range(r.randrange(1, 6)))]
    rows += [(500, t, "u", str(t)) for t in range(60)] + [(501, t, "u", str(t)) for t in range(59)] + [(700, t, "u", "x") for t in range(40)]
    rows += [(None, 1, "u", "x"), (800, None, None, None), (801, 3, "u", "y" * 100_000), (801, 3, "a", "z"), (801, 3, "a", "b")]
    rows += [rows[0]] * 30
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(turns(spark, rows)).collect()), key=repr) == plain_trie(rows)


def test_trie_of_long_conversations_that_part_late(spark):
    rows = [(c, t, "u", f"{t}" if t < 25 else f"{c}-{t}") for c in (1000, 1100, 1200) for t in range(300)] + [(1300, t, "u", f"{t}") for t in range(28)]
    assert sorted((tuple(x) for x in prefix_trie.prefix_trie(turns(spark, rows)).collect()), key=repr) == plain_trie(rows)


def test_trie_of_many_equal_conversations_and_rows(spark):
    rows = [(c, t, "u", "same") for c in range(3000) for t in range(3)] + [(5000, 1, "u", "again")] * 4000
    got = prefix_trie.prefix_trie(turns(spark, rows))
    assert got.filter("depth <= 3").count() == len({(x[0], x[1]) for x in plain_trie(rows) if x[1] <= 3})
    assert got.agg({"depth": "max"}).first()[0] == max(x[1] for x in plain_trie(rows))


def test_trie_of_an_empty_table(spark):
    out = prefix_trie.prefix_trie(turns(spark, []))
    assert out.collect() == []
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_ends_are_hashed_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 80)
    ids = [*range(-50, 400, 3)]
    rows = spark.createDataFrame([(bytearray(k), i) for i in ids for k in (b"a", b"b")] + [(bytearray(b"c"), 9)], "key binary, conv_id long")
    want = {b"a": sha(",".join(map(str, ids))), b"b": sha(",".join(map(str, ids))), b"c": sha("9")}
    assert {bytes(x[0]): x[1] for x in prefix_trie.end_hashes(rows).collect()} == want
