"""Rows that repeat by the thousand, and long token sets: results stay right, and work in proportion to the rows."""

from __future__ import annotations

import random
import time

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardloom.llm import chunk_encoding, near_dedup, url_filters

WORDS = [f"w{i}" for i in range(3000)]
N = 10_000


def text(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def repeated(spark, rows):
    """(n, doc_id, text) to n rows each."""
    return spark.createDataFrame(rows, "n int, doc_id long, text string").withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select("doc_id", "text")


def test_chunks_of_equal_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    long = " ".join(text(900, 1))
    rows = [(N, 5, long), (1, 6, long), (3, 5, long[:3000] + " other"), (2, None, long), (1, None, "x")]
    began = time.monotonic()
    got = chunk_encoding.encode_with_reuse(repeated(spark, rows), path).groupBy("doc_id", "ids", "decoded", "n_tokens").count().collect()
    assert time.monotonic() - began < 240
    tok = Tokenizer.from_file(path)
    want = {(d, t): (n, tok.encode(t, add_special_tokens=False).ids) for n, d, t in rows}
    assert len(got) == len(want)
    for x in got:
        n, ids = want[x.doc_id, x.decoded]
        assert x["count"] == n and x.n_tokens == len(ids) and bytes(x.ids) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_near_texts_of_equal_rows_that_are_not_similar(spark):
    one = text(400, 2)
    two = list(one)
    for i in range(3, 400, 27):
        two[i] = f"x{i}"
    three = list(one)
    three[7] = "other"
    sets = [{tuple(t[i : i + 5]) for i in range(396)} for t in (one, two, three)]
    assert 0.6 < len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.75 < len(sets[0] & sets[2]) / len(sets[0] | sets[2])
    rows = [(N, 1, " ".join(one)), (N, 2, " ".join(two)), (1000, 3, " ".join(three))]
    began = time.monotonic()
    got = near_dedup.near_duplicates(repeated(spark, rows)).groupBy("doc_id", "component_id", "kept").count().collect()
    assert time.monotonic() - began < 180
    assert {tuple(x) for x in got} == {(1, 1, True, N), (2, 2, True, N), (3, 1, False, 1000)}


def test_urls_of_many_tokens(spark):
    long = "/".join(f"t{i}" for i in range(60))
    pages = repeated(spark, [(N, 1, f"http://example.com/de/{long}"), (2000, 2, "http://a.example.org/p/x"), (3000, 3, "http://b.example.org/q/x")]).select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))
    began = time.monotonic()
    assert {tuple(x) for x in url_filters.judge_urls(pages).groupBy("page_id", "rule").count().collect()} == {(1, "example.com/de/", N), (2, None, 2000), (3, None, 3000)}
    keys = "&".join(f"k{i}=1" for i in range(30))
    part = F.col("id") % 3
    url = F.concat(F.when(part == 0, "http://x.net/").when(part == 1, "http://y.example.com/de/").otherwise("http://z.com/en/"), F.lit("s"), F.col("id") % 20, F.when(F.col("id") % 500 == 0, "?" + keys).otherwise(""))
    assert url_filters.judge_urls(spark.range(100_000).select(F.col("id").alias("page_id"), url.alias("url"))).count() == 100_000
    assert time.monotonic() - began < 120


def test_tokens_on_the_same_pages_are_one_item(spark):
    rows = [("http://a.com/x-y/1", True)] * 30 + [("http://b.com/x-y/2", False)] * 30 + [("http://c.com/z", None)] * 5
    pages = url_filters.labelled_tokens(spark.createDataFrame(rows, "url string, bad boolean"))
    items = {x.token: (x.item, x.pages, x.decided, x.blocked) for x in url_filters.token_items(pages, 20).collect()}
    assert items == {"h:a": ("h:a", 30, 30, 30), "p:x": ("p:#", 60, 60, 30), "p:y": ("p:#", 60, 60, 30), "p:#": ("p:#", 60, 60, 30), "h:com": ("h:com", 65, 60, 30)}


def test_minimal_rules_go_from_size_to_size(spark):
    sets = [(["a"], False), (["b"], False), (["c"], False), (["a", "b"], True), (["a", "c"], False), (["b", "c"], False), (["a", "b", "c"], True), (["d"], True), (["a", "d"], False), (["b", "d"], False), (["a", "b", "d"], True)]
    out = url_filters.minimal(spark.createDataFrame(sets, "tokens array<string>, rule boolean")).collect()
    assert sorted(tuple(x.tokens) for x in out) == [("a", "b"), ("d",)]


def test_language_model_of_random_labelled_text_is_bounded(spark):
    from cardloom.llm import language_id

    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=12)) for _ in range(60)), f"l{i % 3}") for i in range(1, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bound = 200_000
    model = language_id.train(docs, sample_bytes=bound)
    # One n-gram of each order and a share of a word for each letter, and the sample's hash may take a few rows more.
    assert 0 < len(model.value) <= 1.3 * bound * (len(language_id.ORDERS) + 1)
    assert sum(x.nbytes for x in (model.keys, model.at, model.lang, model.value)) <= 22 * len(model.value) + 8


def test_scores_of_steps_at_rest(spark):
    """Three steps equal three plain ones; at rest the held-out perplexity is lower than after one."""
    import math
    from collections import Counter

    import numpy as np
    import pytest

    from cardloom.llm import lm_scoring
    from cardloom.llm.lattice import expected_counts, log_probabilities, pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(d, " ".join(text(60, d))) for d in range(1, 25)] + [(30, "the stone and the light"), (31, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = [d for d, _ in rows if not lm_scoring.is_held_out(d)]
    counts = Counter(w for d, t in rows if d in training for w in t.split())
    v, words, ends = pieces(path), list(counts), len(training) + 1.0
    log_p = np.log(v.prior)
    for _ in range(3):
        expected = lm_scoring.PRIOR_COUNT * v.prior + expected_counts(v, log_p, words, np.array([counts[w] for w in words], float))
        log_p = np.log(expected / expected.sum())
    log_p, log_end = np.log(expected / (expected.sum() + ends)), math.log(ends / (expected.sum() + ends))
    for x in lm_scoring.score_documents(docs, path, steps=3).collect():
        own = dict(rows)[x.doc_id].split()
        assert x.score == pytest.approx((log_probabilities(v, log_p, own).sum() + log_end) / math.log(10), rel=1e-9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [lm_scoring.score_documents(docs, path, steps).filter("held_out").toPandas() for steps in (1, None)]
    assert lm_scoring.perplexity(held[1]) < lm_scoring.perplexity(held[0])
