"""Each operator against a plain version, over texts chosen to be awkward."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardloom.llm import chunk_encoding, exact_dedup, language_id, lm_scoring, near_dedup, packing, pii, quality_rules, token_records, url_filters

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, key string, gone long, spans string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("the of and to in stone river light hand word".split()) + str(r.randrange(400)) for _ in range(n))


def texts() -> dict[int, str | None]:
    base, long = words(400, 1), words(3000, 2)
    changed = base.split()
    for i in range(0, 400, 60):
        changed[i] = f"x{i}"
    out = [
        None, "", " ", "\n\n", "a", "Hello World", "hello world", "HELLO WORLD", "one two three four", "One two three FOUR", base, base.upper(), " ".join(changed), base + " end",
        long, long + " " + base, "zwei ß Straße\u0085x\u00a0y", "日本語のテキスト 😀 <|endoftext|> x", "tab\tand\r\nline\n line", "x" * 5000, "1 2 3 " * 300, "Ünï cödé " * 50,
        "mail a@b.co, c_d@e-f.org; ip 10.0.0.1 or 300.1.1.1; card 4111 1111 1111 1111, 4111111111111112; tel +1 (555) 123-4567",
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +12 34 0000000000000000", "same line\nsame line\nother\nsame line", "r s t u v " * 20,
    ]
    return dict(enumerate(out)) | {100: "repeated row", 101: "a b c d e f", 102: "a b c d e f g"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, ("en", "de", None)[d % 3], ("s0", None)[d % 2], None if t is None else len(t), "x", "y", d, "z") for d, t in texts().items()]
    return spark.createDataFrame(rows + [(100, "repeated row", "en", "s0", 12, "x", "y", 1, "z")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(BPE)


def ids_of(tok, text: str | None) -> list[int]:
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_records(spark, docs, empty, tok, tmp_path):
    path = f"file://{tmp_path}/records"
    token_records.write_token_records(docs, path, BPE, end_id=2, shard_bytes=2000)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in token_records.read_token_records(spark, path).collect())
    want, start = [], 0
    for d, t in sorted([*texts().items(), (100, "repeated row")], key=lambda x: x[0]):
        ids = [*ids_of(tok, t), 2]
        want.append((d, start, len(ids), crc(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == sorted(want)
    shuffled = token_records.read_token_records(spark, path, ids=False, shuffle_seed=5).collect()
    assert sorted(r.doc_id for r in shuffled) == [w[0] for w in want] and [r.doc_id for r in shuffled] != [w[0] for w in want]
    token_records.write_token_records(empty, f"file://{tmp_path}/none", BPE)
    assert token_records.read_token_records(spark, f"file://{tmp_path}/none").count() == 0
    shard = next(p for p in (tmp_path / "records").iterdir() if p.suffix == ".tok")
    raw = bytearray(shard.read_bytes())
    raw[len(raw) // 2] ^= 1
    shard.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        token_records.read_token_records(spark, path).collect()


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in [*texts().items(), (100, "repeated row")]:
        groups[(t or "").translate(LOWER)].append(d)
    want = sorted((d, max(g), len(g), d == max(g)) for g in groups.values() for d in g)
    assert sorted(tuple(r) for r in exact_dedup.exact_groups(docs).collect()) == want
    assert sorted(tuple(r) for r in exact_dedup.exact_groups(docs, filter_bits=1 << 15, prefix_chars=1).collect()) == want
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, k, _, _ in want if d == k)
    assert exact_dedup.exact_groups(empty).count() == 0


def check_packed(rows, want: dict[int, list[int]], capacity: int) -> int:
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for d, ids in want.items():
        expected = []
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected.append((k, a, b - a, crc(ids[a:b])))
        assert sorted(set(pieces[d])) == expected
    return len(bins)


def test_packing(docs, empty, tok):
    rows = packing.pack_documents(docs, BPE, 128, end_id=2).collect()
    n = check_packed(rows, {d: [*ids_of(tok, t), 2] for d, t in texts().items()}, 128)
    assert n <= packing.lower_bound(np.array([r.length for r in rows]), 128) + 1
    assert packing.pack_documents(empty, BPE, 128).count() == 0


def test_packing_exchanges(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(d, 0, 0, r.choice((r.randint(1, 1023), 400, 600)), d) for d in range(70_000)], packing.PIECES)
    out = packing.pack(rows, 1024).collect()
    assert sorted(x.doc_id for x in out) == list(range(70_000))
    bins = defaultdict(int)
    for x in out:
        bins[x.sequence_id] += x.length
    assert max(bins.values()) <= 1024
    bound = packing.lower_bound(np.array([x.length for x in out]), 1024)
    assert bound <= len(bins) <= bound * 1.005


def test_lower_bound_holds():
    r = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted((r.randint(1, 40) for _ in range(9)), reverse=True))
        best = packing.best_fit_decreasing(lengths, 40)[2]
        assert math.ceil(lengths.sum() / 40) <= packing.lower_bound(lengths, 40) <= best


def test_chunk_encoding(docs, empty, tok):
    got = {(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in chunk_encoding.encode_with_reuse(docs, BPE).collect()}
    want = {(d, len(i), np.array(i, "<u4").tobytes(), tok.decode(i, skip_special_tokens=False)) for d, t in texts().items() for i in [ids_of(tok, t)]}
    assert got == want
    assert chunk_encoding.encode_with_reuse(empty, BPE).count() == 0


def test_chunk_joins_are_exact(tok):
    enc, r = chunk_encoding.encoder(BPE), random.Random(8)
    alphabet = [*" \n\taB1.'é中😀ß", "'s", "  ", " <|endoftext|>", "\u0085", "the "]
    for _ in range(400):
        text = "".join(r.choices(alphabet, k=r.randint(0, 60)))
        cuts = sorted(r.sample(range(len(text) + 1), min(4, len(text))))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        if any(a in text for a in enc.added):
            assert list(enc.encode(text)) == ids_of(tok, text)
        else:
            assert list(np.frombuffer(chunk_encoding.join_chunks(enc, ((p, chunk_encoding.encode_chunk(enc, p)) for p in parts)), "<u4")) == ids_of(tok, text)


def shingles(text: str | None) -> set[tuple]:
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(found: dict[int, set]) -> dict[int, int]:
    parent = {d: d for d in found}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(found[a] & found[b])
            if both and 100 * both >= 75 * (len(found[a]) + len(found[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in found}


def test_near_dedup(docs, empty):
    found = {d: shingles(t) for d, t in texts().items()}
    of = components_of(found)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(d, len(s), of[d], of[d] == d) for d, s in found.items()}
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d in of if of[d] == d}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_links_across_buckets(spark):
    """Chains of texts that drift: each is like the next, the ends aren't alike."""
    rows = []
    for family in range(12):
        w = words(120, 50 + family).split()
        for step in range(9):
            rows.append((len(rows), " ".join(w)))
            w[step * 13 % 120] = f"new{family}x{step}"
    rows = [(d * 7 % 1009, t) for d, t in rows]
    of = components_of({d: shingles(t) for d, t in rows})
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == of and 12 <= len(set(of.values())) < len(rows)


def test_quality_counts(docs, empty):
    rows = quality_rules.judge_quality(docs).collect()
    for r in rows:
        t = texts()[r.doc_id] or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge_quality(empty).count() == 0


def test_quality_outliers(spark):
    """Half of one source is junk of another kind: it goes, the clean half stays."""
    rows = [(d, words(60, d).replace("1", "1,"), "en", "s") for d in range(900)] + [(d, " ".join(f"{w}###$$$" for w in words(60, d).split()), "en", "s") for d in range(900, 1200)]
    rows = [(d, " ".join(f"{w}q{i}" for i, w in enumerate(t.split())), lang, s) for d, t, lang, s in rows]
    got = {r.doc_id: r.kept for r in quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[d] for d in range(900)) and not any(got[d] for d in range(900, 1200))


def test_quality_keeps_clean_rows_of_shared_doc_ids(spark):
    """A rejected row takes no other with it, whether they share a null doc_id or a number."""
    junk = "one two three"
    rows = [(None, words(60, d), "en", "s") for d in range(20)] + [(None, junk, "en", "s"), (None, None, "en", None), (7, junk, None, "s"), (7, words(60, 7), None, "s"), (8, junk, "en", "s"), (9, words(60, 9), "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = [r for r in rows if r[1] not in (junk, None)]
    assert sorted(map(tuple, quality_rules.keep_good(docs).collect()), key=str) == sorted(want, key=str)


def test_chi_square():
    assert quality_rules.chi_square_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_rules.chi_square_cdf(1.0, 2) == pytest.approx(1 - math.exp(-0.5), abs=1e-12)


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    def good(kind: int, hit: str) -> bool:
        d = re.sub("[^0-9]", "", hit)
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
        return [True, all(int(x) <= 255 for x in hit.split(".")) if kind == 1 else True, 14 <= len(d) <= 19 and luhn, 10 <= len(d) <= 15][kind]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if good(k, m.group()))


def test_pii_base(docs, empty):
    got = {(r.doc_id, r.base_sha256) for r in pii.span_report(docs).collect()}
    text = lambda t: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t or ""))
    assert got == {(d, hashlib.sha256(text(t).encode()).hexdigest()) for d, t in texts().items()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[22].startswith("mail <email>, <email>; ip <ip> or 300.1.1.1; card <card>,") and clean[0] is None and clean[5] == "Hello World"
    assert pii.redact(docs).columns == docs.columns and pii.span_report(empty).count() == 0


def test_pii_fuzzed(spark):
    r = random.Random(6)
    parts = ["a", "b.c", "@", ".", "1", "22", "4111111111111111", "+", "(", ")", "-", " ", "_", "%", "255", "256", "é", "😀"]
    rows = [(d, "".join(r.choices(parts, k=r.randint(1, 40)))) for d in range(600)]
    got = {r.doc_id: r.base_sha256 for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t))
        assert got[d] == hashlib.sha256(want.encode()).hexdigest(), t


def test_pii_long_runs(spark):
    """Neither deep recursion nor quadratic retries."""
    rows = [(0, "1" * 200_000), (1, "1 " * 50_000), (2, "a." * 100_000), (3, "a" * 200_000 + "@x" + ".y" * 20_000)]
    got = {r.doc_id: (r.n_email, r.n_card) for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3] == (1, 0) and got[0] == (0, 0)


def test_pii_trees_add_tokens(spark):
    r = random.Random(9)
    secret = lambda: "".join(r.choices("0123456789abcdef", k=40))
    rows = [(d, f'{words(20, d)} token = "{secret()}" {words(5, d)}') for d in range(300)] + [(d, f"{words(20, d)} internationalisation{d}extraordinarily {words(5, d)}") for d in range(300, 600)]
    got = {x.doc_id: x.spans for x in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret" in got[d] for d in range(300)) > 280 and sum("secret" in got[d] for d in range(300, 600)) == 0


def test_url_filters(spark):
    urls = {
        0: None, 1: "no scheme", 2: "http://", 3: "https://A.EXAMPLE.net/en/1", 4: "http://a.example.net/fr", 5: "http://example.com/de/x?y", 6: "http://badexample.com/de/", 7: "http://x.org/fr/", 8: "http://x.org#/fr/",
        9: "http://net/", 10: "http://x.net", 11: "a://b://c/d", 12: "http://h?q=1", 13: "http://xorg/fr/",
    }
    pages = spark.createDataFrame([(i, u, "x", "h") for i, u in urls.items()] + [(3, urls[3], "x", "h")], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(pages, labels).collect()}
    for i, u in urls.items():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")
    assert url_filters.judge_urls(pages.limit(0), labels).count() == 0


def test_url_rules_are_mined(spark):
    """Spam pages share two tokens; either alone is harmless."""
    rows = [(i, f"http://{'casino' if i % 2 else 'shop'}.example.com/{'win' if i % 3 == 0 else 'read'}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(u, i % 2 == 1 and i % 3 == 0) for i, u in rows if i % 5], "url string, bad boolean")
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(pages, labels).collect()}
    assert all((got[i] == "block") == (i % 2 == 1 and i % 3 == 0) for i in range(600))


def tokens_of(url: str) -> frozenset:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url)
    host, path, query = m[1].translate(LOWER), m[2].translate(LOWER), m[3] or ""
    number = lambda x: "#" if re.fullmatch("[0-9]+", x) else x
    return frozenset(["h:" + number(x) for x in host.split(".") if x] + ["p:" + number(x) for x in re.split("[/._-]", path) if x] + ["q:" + x.split("=")[0] for x in query.split("&") if x])


def test_url_verdicts_by_apriori(spark):
    """On a whole table: the mined verdicts are those of a plain search for all frequent sets and confident rules."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in url_filters.judge_urls(pages).collect()}
    sets = {r.page_id: tokens_of(r.url) for r in pages.collect()}
    every = [(sets[i], r.rule is not None, r.rule is not None and r.verdict == "block") for i, r in got.items()]
    least = math.ceil(max(url_filters.SUPPORT, url_filters.LEAST_PAGES / len(every)) * len(every))
    level = {frozenset([t]) for s, _, _ in every for t in s}
    rules = []
    while level:
        counted = {c: [sum(x) for x in zip(*[(c <= s, c <= s and known, c <= s and bad) for s, known, bad in every], strict=True)] for c in level}
        frequent = {c for c, (_, _, bad) in counted.items() if bad >= least}
        rules += [c for c in frequent if counted[c][2] >= url_filters.CONFIDENCE * counted[c][1] and counted[c][2] > url_filters.MAJORITY * counted[c][0]]
        level = {a | b for a in frequent for b in frequent if len(a | b) == len(a) + 1}
    assert rules
    for i, r in got.items():
        assert r.mined == (None if r.rule else any(c <= sets[i] for c in rules))
    assert any(r.mined for r in got.values()) and not all(r.mined for r in got.values() if r.rule is None)


def test_url_rules_on_held_out_pages(spark):
    """Rules mined from four fifths of the pages agree with the listed verdicts on the rest."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    part = F.pmod(F.crc32(F.col("page_id").cast("string")), F.lit(5))
    items, index = url_filters.mined_rules(url_filters.listed_verdicts(pages.filter(part > 0)))
    held = url_filters.listed_verdicts(pages.filter(part == 0)).filter("bad is not null").distinct()
    hit = held.join(url_filters.fired(held.select("url").distinct(), items, index), "url").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    assert hit.n > 50 and hit.bad >= 0.9 * hit.n


def test_language_id(spark, docs, empty):
    r = random.Random(2)
    stems = {"aa": ["lor", "mip", "sut"], "bb": ["kra", "zov", "tek"]}
    text = lambda lang: " ".join("".join(r.choices(stems[lang], k=r.randint(1, 3))) for _ in range(30))
    rows = [(d, text(("aa", "bb")[d % 2]), ("aa", "bb")[d % 2] if d % 10 else None) for d in range(400)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(train)
    got = {x.doc_id: x for x in language_id.identify_languages(train, model).collect()}
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in set(held)) for d in range(400))
    assert all(got[d].lang_pred == ("aa", "bb")[d % 2] for d in held) and all(0 <= x.score <= 1 for x in got.values())
    odd = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify_languages(docs, model).collect()}
    assert odd[0] == odd[1] == odd[3] == odd[20] == ("und", 0.0) and odd[10][0] in ("aa", "bb")
    none = language_id.train(empty)
    assert {x.lang_pred for x in language_id.identify_languages(docs, none).collect()} == {"und"} and language_id.identify_languages(empty, none).count() == 0


def test_lm_scoring(docs, empty):
    rows = {r.doc_id: r for r in lm_scoring.score_documents(docs, PIECES).collect()}
    found = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in [*texts().items(), (100, "repeated row")]]
    c: Counter = Counter()
    for d, w in found:
        if zlib.crc32(str(d).encode()) % 10:
            c.update([*w, "\n"])
    n, v = sum(c.values()), len(c)
    for d, w in found:
        tokens = [*w, "\n"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert lm_scoring.score_documents(empty, PIECES).count() == 0


def test_lattice_sums_all_segmentations():
    from cardloom.llm.lattice import MARK, expected_counts, log_probabilities, pieces

    v = pieces(PIECES)
    log_p, at = np.log(v.prior), {t: i for i, t in enumerate(v.texts)}

    def total(s: str) -> float:
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            if (i := at.get(s[:k])) is not None:
                out += math.exp(log_p[i]) * total(s[k:])
            elif k == 1:
                out += math.exp(sum(log_p[v.n + b] for b in s[0].encode())) * total(s[1:])
        return out

    sample = ["the", "", "ab漢", "stones", "x😀y", "naïve"]
    assert np.allclose(log_probabilities(v, log_p, sample), [math.log(total(MARK + w)) for w in sample])
    counts = expected_counts(v, log_p, ["ab"], np.array([2.0]))
    lengths = np.array([len(t) for t in v.texts] + [0] * 256)
    assert (counts * lengths).sum() == pytest.approx(6.0)


def test_pipeline(spark, docs, tok):
    import corpus_pipeline

    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == docs.columns
        rows = corpus_pipeline.materialize(rows, "test")
    kept = {r.doc_id: r.text for r in rows.collect()}
    good = {r.doc_id for r in quality_rules.judge_quality(docs).filter("kept").collect()}
    last: dict[str, int] = {}
    for d in good:
        t = (texts()[d] or "").translate(LOWER)
        last[t] = max(d, last.get(t, -1))
    of = components_of({d: shingles(texts()[d]) for d in last.values()})
    assert set(kept) == {d for d in of if of[d] == d}
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, "").collect()
    check_packed(packed, {d: [*ids_of(tok, t), 2] for d, t in kept.items()}, corpus_pipeline.CAPACITY)


def test_null_doc_ids(spark, tmp_path):
    rows = spark.createDataFrame([(None, "some words in here for a test " + words(20, 1)), (None, None), (1, words(20, 1)), (2, words(20, 1))], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    assert exact_dedup.exact_groups(rows).count() == 4
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (None, None), (1, 1), (2, 1)], key=str)
    assert quality_rules.judge_quality(rows).count() == 4 and pii.span_report(rows).count() == 4
    assert packing.pack_documents(rows, BPE, 64, 2).count() >= 4 and lm_scoring.score_documents(rows, PIECES).count() == 4
    assert chunk_encoding.encode_with_reuse(rows, BPE).count() == 4 and language_id.identify_languages(rows, language_id.train(rows)).count() == 4
    token_records.write_token_records(rows, f"file://{tmp_path}/r", BPE, 2)
    assert sorted(str(r.doc_id) for r in token_records.read_token_records(spark, f"file://{tmp_path}/r").collect()) == ["1", "2", "None", "None"]


def test_pii_dense_text(spark):
    """A text of nothing but matches takes time in proportion to its length."""
    import time

    n = 100_000
    rows = [(0, "1.2.3.4 " * n), (1, "a@b.co " * (n // 4)), (2, "+12345678901 é " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = time.time()
    got = {r.doc_id: r for r in pii.span_report(docs).collect()}
    assert got[0].n_ip == n and got[1].n_email == n // 4 and got[2].n_phone == 5000
    assert got[0].base_sha256 == hashlib.sha256(",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(n)).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "<ip> " * n and clean[1] == "<email> " * (n // 4) and clean[2] == "<phone> é " * 5000
    assert time.time() - at < 240


def test_pii_selects_by_held_out_precision(spark):
    """The spans that are added are those that a plain reading of the rule gives, from the trees' own scores."""
    r = random.Random(11)
    mail = lambda: f"u{r.randrange(999)} (at) site{r.randrange(99)}.org"
    plain = lambda: f"u{r.randrange(999)}@site{r.randrange(99)}.org"
    rows = [(d, f"{words(10, d)} {plain()} {words(5, d)} {mail()} {words(4, d)}") for d in range(400)]
    got = {x.doc_id: x.spans for x in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        base = [f"email:{m.start()}:{m.end()}" for m in re.finditer(PATTERNS[0], t)]
        spans = got[d].split(",")
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: int(s.split(":")[1]))
        edges = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in spans)
        assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_language_scores_by_hand(spark):
    """Every prediction equals a plain version with counters, and letters are letters only."""
    r = random.Random(8)
    stems = {"aa": ["lor", "mip", "sut", "ñandú"], "bb": ["kra", "zov", "tek", "straße"], "cc": ["lor", "zov", "ba"]}
    rows = [(d, " ".join("".join(r.choices(stems[x], k=r.randint(1, 3))) for _ in range(12)), x) for d, x in enumerate(r.choices(list(stems), k=150))]
    odd = [(1000, "½ ² Ⅷ", None), (1001, "٣ _ 12", None), (1002, "ǅ ª", None), (1003, "lorx kraz unseen 日本", None), (1004, "x" * 300_000, None), (1005, "lormip " * 60_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    split = lambda t: ["".join(g) for k, g in __import__("itertools").groupby(t.lower(), str.isalpha) if k]
    counts = {x: [Counter() for _ in range(6)] for x in stems}
    for d, t, x in rows:
        if not held(d):
            for w in split(t):
                counts[x][0][w] += 1
                for o in language_id.ORDERS:
                    counts[x][o].update(language_id.grams(w, o))
    log_p = lambda x, k, g: math.log((counts[x][k][g] + 0.5) / (sum(counts[x][k].values()) + 1))

    def evidence(w: str, x: str) -> float:
        known = lambda k, g: any(counts[y][k][g] for y in stems)
        if known(0, w):
            return log_p(x, 0, w)
        for o in language_id.ORDERS:
            some = [g for g in language_id.grams(w, o) if known(o, g)]
            if some:
                return sum(log_p(x, o, g) for g in some) / len(some)
        return 0.0

    got = {x.doc_id: x for x in language_id.identify_languages(docs, language_id.train(docs)).collect()}
    for d, t, _ in rows + odd:
        ws = split(t)
        if not ws:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        each = Counter(ws)
        sums = {x: sum(n * evidence(w, x) for w, n in each.items()) for x in sorted(stems)}
        best = max(sums, key=lambda x: sums[x])
        scale = min(1.0, 20 / len(ws))
        assert got[d].lang_pred == best or abs(sums[best] - sums[got[d].lang_pred]) < 1e-3 * abs(sums[best])
        assert got[d].score == pytest.approx(1 / sum(math.exp(scale * (s - sums[got[d].lang_pred])) for s in sums.values()), abs=1e-3)


def test_lm_score_end_to_end(spark):
    """The model's score equals a plain run of the recursion over counts made in Python."""
    from cardloom.llm.lattice import expected_counts, log_probabilities, pieces

    rows = [(d, t) for d, t in texts().items()]
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()}
    split = {d: WORD.findall((t or "").translate(LOWER)) for d, t in rows}
    training = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 10 != 0]
    c = Counter(w for d in training for w in split[d])
    v = pieces(PIECES)
    names = list(c)
    expected = lm_scoring.PRIOR_COUNT * v.prior + expected_counts(v, np.log(v.prior), names, np.array([c[w] for w in names], float))
    ends = len(training) + 1.0
    log_p, log_end = np.log(expected / (expected.sum() + ends)), math.log(ends / (expected.sum() + ends))
    every = sorted({w for ws in split.values() for w in ws})
    each = dict(zip(every, log_probabilities(v, log_p, every), strict=True))
    for d, _ in rows:
        want = (sum(each[w] for w in split[d]) + log_end) / math.log(10)
        assert got[d].score == pytest.approx(want, rel=1e-9)
    first = {r.doc_id: r.score for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), PIECES, steps=0).collect()}
    assert first[14] < got[14].score < 0


def test_pipeline_edges(spark, empty):
    """An empty table, null and repeated doc_ids, null texts, ties and columns with the stages' own names."""
    import corpus_pipeline

    a, b, c = words(80, 1), words(80, 2), words(80, 3)
    junk = "same few words " * 40
    near = a.split()
    near[40] = "changed"
    rows = [
        (None, a, "k1"), (None, b, "k2"), (None, junk, "k3"), (None, None, "k4"), (1, junk, "k5"), (1, c, "k6"), (2, c.upper(), "k7"), (2, c.upper(), "k8"), (3, " ".join(near), "k9"), (4, a, "k10"),
        (5, b + " mail a@b.co", "k11"),
    ]
    names = "doc_id long, text string, key string, row string, spans string, _in boolean, bitmap string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, k, "r", "s", True, "m", "en", None, None if t is None else len(t)) for d, t, k in rows], names)
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.materialize(stage(spark, at, ""), f"edge-{name}")
        assert at.columns == docs.columns
        kept = {r.key for r in at.collect()}
        if name == "quality":
            assert kept == {"k1", "k2", "k6", "k7", "k8", "k9", "k10", "k11"}
        elif name == "exact_dedup":
            assert kept == {"k2", "k7", "k8", "k9", "k10", "k11"}
        elif name == "near_dedup":
            assert kept == {"k2", "k7", "k8", "k9", "k11"}
    assert [r.text.endswith("mail <email>") and r.n_chars == len(r.text) for r in at.filter("key = 'k11'").collect()] == [True]
    assert corpus_pipeline.STAGES[-1][1](spark, at, "").select("doc_id").distinct().count() == 4
    none = empty.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0


def test_mcd_finds_the_least_determinant(spark):
    """On small groups, the estimate's subset is as tight as the best of many plain concentration runs."""
    r = np.random.default_rng(5)
    v = np.concatenate([r.normal(size=(240, 5)) @ np.diag([0.3, 0.4, 0.2, 0.5, 0.3]), r.normal(3, 0.2, size=(60, 5))])
    rows = spark.createDataFrame([("g", x.tolist()) for x in v], "key string, v array<double>")
    fit = quality_rules.robust_fits(rows).first()
    h = int(quality_rules.SUBSET * len(v))

    def shape(mean: np.ndarray, inverse: np.ndarray) -> float:
        gap = v - mean
        near = np.argsort(np.einsum("ij,jk,ik->i", gap, inverse, gap))[:h]
        return np.linalg.slogdet(np.cov(v[near].T, bias=True))[1]

    best = math.inf
    for seed in range(30):
        some = np.random.default_rng(seed).choice(len(v), 12, replace=False)
        for _ in range(15):
            mean, inverse = v[some].mean(axis=0), np.linalg.inv(np.cov(v[some].T, bias=True) + 1e-6 * np.eye(5))
            gap = v - mean
            some = np.argsort(np.einsum("ij,jk,ik->i", gap, inverse, gap))[:h]
        best = min(best, np.linalg.slogdet(np.cov(v[some].T, bias=True))[1])
    mean, inverse = np.array(fit.mean), np.array(fit.inverse).reshape(5, 5)
    assert shape(mean, inverse) < best + 0.3
    far = np.einsum("ij,jk,ik->i", v - mean, inverse, v - mean)
    assert (far[240:] > quality_rules.CUTOFF).all() and (far[:240] > quality_rules.CUTOFF).mean() < 0.05


def test_very_long_texts(spark):
    """A text of some megabytes goes through every operator whole."""
    text = words(200_000, 7)
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, text + " end", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {1}
    assert {r.n_words for r in quality_rules.judge_quality(docs).collect()} == {200_000, 200_001}
    assert [r.group_size for r in exact_dedup.exact_groups(docs).collect()] == [1, 1]
    assert {r.n_tokens for r in lm_scoring.score_documents(docs, PIECES).collect()} == {200_001, 200_002}
    pieces = packing.pack_documents(docs, BPE, 1024, 2).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    n = {r.doc_id: r.n_tokens for r in chunk_encoding.encode_with_reuse(docs, BPE, chunk_encoding.digests, chunk_encoding.DIGESTS).collect()}
    assert {r.doc_id: r.n - 1 for r in pieces} == n and all(x > 200_000 for x in n.values())


def test_pipeline_runs_whole(spark, tok):
    """run() gives what its stages give one after another, and leaves only the last stage's own tables."""
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialize(stage(spark, rows, sf_dir), f"whole-{name}")
    kept = {r.doc_id: r.text for r in rows.collect()}
    assert kept and len({r.doc_id for r in packed}) == len(kept)
    check_packed(packed, {d: [*ids_of(tok, t), 2] for d, t in kept.items()}, corpus_pipeline.CAPACITY)
