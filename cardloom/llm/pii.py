"""Personal data: rules first, then boosted trees over high-recall candidates, in DataFrame operations only.

The base rules find e-mail addresses, IP addresses, payment cards and phone numbers, leftmost and non-overlapping per
kind, and drop what fails its check.  Broader generators propose further spans, which may overlap: addresses with ``(at)``
or odd spacing, runs of digits with separators, long mixed tokens.  Boosted trees score each candidate by its format and
its context; they learn from weak labels - a candidate that a base rule confirms (or, for tokens, one that an assignment
such as ``token =`` introduces) is positive - and never see the confirming check itself.  On a held-out part of the
candidates each family gets the least threshold at which ``PRECISION`` of what it selects is confirmed; a family without
such a threshold adds nothing.  Selected spans that overlap no base span and no earlier selected one are added.

One scan finds all spans; only spans, not texts, are shuffled.  Candidates meet the base spans that they overlap by blocks of
the text, not each with each.  The trees learn from all candidates outside the held-out fifth, and the thresholds from all
inside it; candidates are few beside texts, and a pass over them is one of Spark's own.  Where a tree may split a feature is
fixed beforehand (``SPLITS``), each place being a feature of its own that is 0 or 1: for numbers MLlib would choose places
from a sample of the rows.

Null texts are empty and have no spans; an empty table gives no rows; rows that repeat get the same spans each; other
columns are not read. Very long texts, and texts of nothing but matches, take time in proportion to their length: what a
fold puts out is gathered ``CHUNK`` items at a time. Of added spans that overlap, the one that begins first stays, then by
kind, then the shorter one. Positions are in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import documents, flagged, materialize, row_key

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
#: Held-out candidates that a threshold must select for its precision to count.
LEAST_HELD = 20
TREES, DEPTH = 10, 4
#: A run begins where its first class of characters does, or where the last match ended: no quadratic retries.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+"
NUMBER = r"(?<![A-Za-z0-9])[+(]{0,2}+[0-9](?:[ ().\-]{0,2}[0-9]){6,}+"
TOKEN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
ASSIGNED = r"(?i)(?:token|secret|password|passwd|key)\s*[=:]\s*[\"']?$"
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_FOUND = "array<struct<start:int,end:int,family:string,hit:string,before:string,after:string>>"
CHUNK = 128
#: Code points of a text that lie in one block, or in one piece.
BLOCK = 256
FEATURES = (
    "spelled", "number", "token", "length", "digits", "letters", "upper", "separators", "groups", "dots", "plus", "parens", "at", "distinct",
    "before_letter", "before_space", "before_quote", "before_equals", "after_letter", "after_space", "after_quote", "after_end",
)
_SHARES = tuple(k / 32 for k in range(1, 32))
_LENGTHS = (8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 40, 44, 48, 52, 56, 60, 64, 80, 96, 128, 192, 256, 512, 1024)
#: A feature lies above one of these, or doesn't; features that aren't named are 0 or 1 by themselves.
SPLITS = {"length": _LENGTHS, "groups": tuple(range(1, 17)), "dots": tuple(range(8)), **dict.fromkeys(("digits", "letters", "upper", "separators", "distinct"), _SHARES)}


def _octets(hit: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(hit, r"\."), small)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, start: Column, step: Callable[[Column, Column], Column], kinds: str) -> Column:
    """A fold whose step takes (state, item) to a struct of ``state`` and ``out``, an array of the type ``kinds``.  Gives the
    last state and all that was put out, in order.  An array that grows by one item a step would be copied at each."""
    empty = F.array().cast(kinds)

    def part(state: Column, some: Column) -> Column:
        one = lambda acc, x: _let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))
        return F.aggregate(some, F.struct(state.alias("state"), empty.alias("out")), one)

    def whole(all_: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(all_) - 1) / CHUNK), F.lit(0)).cast("int"))
        one = lambda acc, c: _let(part(acc["state"], F.slice(all_, c * CHUNK + 1, F.lit(CHUNK))), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))
        zero = F.struct(start.alias("state"), F.array().cast(f"array<{kinds}>").alias("outs"))
        return F.aggregate(chunks, zero, one, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["outs"]).alias("out")))

    return _let(items, whole)


def _walk(text: Column, pattern: str, valid: Callable[[Column], Column], rank: int, kind: str, guard: Column) -> Column:
    """All valid matches with their positions: the parts between matches, and the matches, one after another."""
    zipped = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def step(at: Column, z: Column) -> Column:
        hit = z["1"]
        start = at + F.coalesce(F.length(z["0"]), F.lit(0))
        end = start + F.coalesce(F.length(hit), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))).cast(_SPANS)
        return F.struct(end.alias("state"), F.when(hit.isNotNull() & valid(hit), span).otherwise(F.array().cast(_SPANS)).alias("out"))

    return F.when(guard, _fold(zipped, F.lit(0), step, _SPANS)["out"]).otherwise(F.array().cast(_SPANS))


def _proposed(text: Column, pattern: str, valid: Callable[[Column], Column], family: str, guard: Column) -> Column:
    """All matches with their positions, the 24 characters before them and the first ones after them."""
    parts = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tail = lambda x: F.slice(x, F.lit(2), F.size(x))
    zipped = _let(F.struct(parts.alias("p"), hits.alias("h")), lambda z: F.arrays_zip(z["p"], z["h"], tail(z["p"]), tail(z["h"])))

    def step(state: Column, z: Column) -> Column:
        part, hit = F.coalesce(z["p"], F.lit("")), z["h"]
        start = state["at"] + F.length(part)
        end = start + F.coalesce(F.length(hit), F.lit(0))
        before = F.right(F.concat(state["tail"], F.right(part, F.lit(24))), F.lit(24))
        after = F.coalesce(F.nullif(F.left(z["2"], F.lit(8)), F.lit("")), F.left(z["3"], F.lit(8)), F.lit(""))
        fields = [start.alias("start"), end.alias("end"), F.lit(family).alias("family"), hit.alias("hit"), before.alias("before"), after.alias("after")]
        out = F.when(hit.isNotNull() & valid(hit), F.array(F.struct(*fields)).cast(_FOUND)).otherwise(F.array().cast(_FOUND))
        last = F.right(F.concat(before, F.right(F.coalesce(hit, F.lit("")), F.lit(24))), F.lit(24))
        return F.struct(F.struct(end.alias("at"), last.alias("tail")).alias("state"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    return F.when(guard, _fold(zipped, zero, step, _FOUND)["out"]).otherwise(F.array().cast(_FOUND))


def base_spans(text: Column) -> Column:
    """Spans of the four kinds that pass their checks, by start, then kind."""
    yes = lambda hit: F.lit(True)
    digit = text.rlike(r"[0-9][\x20.-]?[0-9]")
    found = [
        _walk(text, EMAIL, yes, 0, "email", F.contains(text, F.lit("@"))),
        _walk(text, IP, _octets, 1, "ip", text.rlike(r"[0-9]\.[0-9]")),
        _walk(text, CARD, _luhn, 2, "card", digit),
        _walk(text, PHONE, lambda h: F.length(_digits(h)).between(10, 15), 3, "phone", F.contains(text, F.lit("+"))),
    ]
    return F.array_sort(F.concat(*found))


def candidate_spans(text: Column) -> Column:
    any_, has_digit = (lambda h: F.lit(True)), (lambda h: h.rlike("[0-9]"))
    found = [
        _proposed(text, SPELLED, any_, "spelled", F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")),
        _proposed(text, NUMBER, any_, "number", text.rlike(r"[0-9][ ().\-]{0,2}[0-9]")),
        _proposed(text, TOKEN, has_digit, "token", text.rlike(r"[A-Za-z0-9_-]{20}")),
    ]
    return F.concat(*found)


def _ratio(hit: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(hit, pattern, "")) / F.length(hit)


def found_spans(docs: DataFrame) -> DataFrame:
    """key, doc_id, base, candidates (with the characters around each): one scan, no text in the result."""
    text = F.col("text")
    return documents(docs).select(row_key(F.col("doc_id"), text).alias("key"), "doc_id", base_spans(text).alias("base"), candidate_spans(text).alias("candidates"))


def _blocks(spans: DataFrame) -> DataFrame:
    block = lambda at: F.floor(at / BLOCK).cast("int")
    return spans.withColumn("block", F.explode(F.sequence(block(F.col("start")), F.greatest(block(F.col("end") - 1), block(F.col("start"))))))


def candidates(found: DataFrame) -> DataFrame:
    """One row per candidate of each text: key, start, end, family, features, and its weak label."""
    some = found.filter(F.size("candidates") > 0)
    rows = some.select("key", F.explode("candidates").alias("c")).select("key", "c.*").distinct()
    base = some.select("key", F.explode("base").alias("s")).select("key", "s.start", "s.end").distinct()
    place = ["key", "start", "end", "family"]
    met = _blocks(rows.select(*place)).join(_blocks(base).withColumnsRenamed({"start": "s", "end": "e"}), ["key", "block"])
    shared = F.least("e", "end") - F.greatest("s", "start")
    met = met.groupBy(*place).agg(F.max(shared).alias("shared"))
    rows = rows.join(met, place, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    confirmed = F.col("shared") * 5 >= (F.col("end") - F.col("start")) * 4
    touched = F.col("shared") > 0
    label = F.when(F.col("family") == "token", F.col("before").rlike(ASSIGNED)).otherwise(confirmed)
    last, first = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    hit = F.col("hit")
    values = {
        "spelled": F.col("family") == "spelled", "number": F.col("family") == "number", "token": F.col("family") == "token",
        "length": F.length(hit), "digits": _ratio(hit, "[^0-9]"), "letters": _ratio(hit, "[^A-Za-z]"), "upper": _ratio(hit, "[^A-Z]"),
        "separators": _ratio(hit, "[^ ().-]"), "groups": F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))), "dots": _ratio(hit, "[^.]") * F.length(hit),
        "plus": F.startswith(hit, F.lit("+")), "parens": F.contains(hit, F.lit("(")), "at": F.contains(hit, F.lit("@")),
        "distinct": F.size(F.array_distinct(F.split(hit, ""))) / F.length(hit),
        "before_letter": last.rlike(r"\p{L}"), "before_space": last.rlike(r"\s"), "before_quote": last.rlike("[\"'`]"), "before_equals": F.col("before").rlike("[=:]"),
        "after_letter": first.rlike(r"\p{L}"), "after_space": first.rlike(r"\s"), "after_quote": first.rlike("[\"'`]"), "after_end": first == "",
    }
    return rows.select("key", "start", "end", "family", "hit", touched.alias("touched"), label.cast("double").alias("label"), *[values[n].cast("double").alias(f"f_{n}") for n in FEATURES])


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the vector ``features``: for each feature and each place where it may be split, whether it lies above. Marked
    as binary, so that MLlib has no places to choose."""
    above = lambda x: F.transform(F.array(*[F.lit(float(t)) for t in SPLITS.get(x, (0.5,))]), lambda t: (F.col(f"f_{x}") > t).cast("double"))
    names = [f"{x}>{t:g}" for x in FEATURES for t in SPLITS.get(x, (0.5,))]
    marks = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": n} for i, n in enumerate(names)]}, "num_attrs": len(names)}}
    vector = array_to_vector(F.concat(*[above(x) for x in FEATURES]))
    return rows.select("*", vector.alias("features", metadata=marks))


def _selected(rows: DataFrame) -> DataFrame | None:
    """The candidates that the trees select; None where there is nothing to learn from."""
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not positive or positive == n:
        return None
    assembled = with_features(rows)
    parts = assembled.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(4)), F.lit(5)))
    learned = parts.filter("fold > 0")
    if learned.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=5).fit(learned.select("features", "label"))
    score = vector_to_array("probability")[1]
    held = model.transform(parts.filter("fold = 0")).groupBy("family", F.floor(score * 100).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("label").alias("good"))
    bins: dict[str, dict[int, tuple[int, float]]] = {}
    for family, b, count, good in held.collect():  # at most 101 bins a family
        bins.setdefault(family, {})[b] = (count, good)
    limits = {}
    for family, of in bins.items():
        count, good = 0, 0.0
        for b in sorted(of, reverse=True):
            count, good = count + of[b][0], good + of[b][1]
            if good >= PRECISION * count and count >= LEAST_HELD and b > 0:
                limits[family] = b / 100
    if not limits:
        return None
    limit = F.lit(None).cast("double")
    for family, least in limits.items():
        limit = F.when(F.col("family") == family, least).otherwise(limit)
    fresh = model.transform(assembled.filter("not touched")).withColumn("score", score).filter(F.col("score") >= limit)
    kind = (
        F.when(F.col("family") == "spelled", "email").when(F.col("family") == "token", "secret").when(F.col("f_dots") == 3, "ip")
        .when((F.col("f_plus") > 0) | (F.col("f_parens") > 0), "phone").otherwise("card")
    )
    rank = F.when(kind == "email", 0).when(kind == "ip", 1).when(kind == "card", 2).when(kind == "phone", 3).otherwise(4)
    return fresh.select("key", F.struct(F.col("start"), rank.cast("int").alias("rank"), F.col("end"), kind.alias("kind")).alias("span"))


def _apart(spans: Column) -> Column:
    """Of spans in order, those that begin at or after the end of the last one taken."""
    taken = lambda at, s: F.struct(F.when(s["start"] >= at, s["end"]).otherwise(at).alias("state"), F.when(s["start"] >= at, F.array(s)).otherwise(F.array().cast(_SPANS)).alias("out"))
    return _fold(F.array_sort(spans), F.lit(0), taken, _SPANS)["out"]


def personal_data(docs: DataFrame) -> DataFrame:
    """key, doc_id, base and spans (base and added ones, by start, then kind): arrays of (start, rank, end, kind)."""
    found = materialize(found_spans(docs), "spans")
    selected = _selected(materialize(candidates(found), "candidates"))
    if selected is None:
        return found.select("key", "doc_id", "base", F.col("base").alias("spans"))
    added = selected.groupBy("key").agg(_apart(F.collect_set("span")).alias("added"))
    joined = found.select("key", "doc_id", "base").join(added, "key", "left")
    return joined.select("key", "doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, base_sha256, spans."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return personal_data(docs).select("doc_id", *[of(k) for k in KINDS], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans in one go."""

    def whole(x: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            some = F.slice(x["pieces"], first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1)
            return F.when(b > a, F.substr(F.array_join(some, ""), a - first * BLOCK + 1, b - a)).otherwise("")

        def step(at: Column, s: Column) -> Column:
            mark = F.when(s["end"] > at, F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise("")
            return F.struct(F.greatest(at, s["end"]).alias("state"), F.array(between(at, s["start"]), mark).alias("out"))

        return _let(_fold(x["spans"], F.lit(0), step, "array<string>"), lambda r: F.concat(F.array_join(r["out"], ""), between(r["state"], x["size"])))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return _let(F.struct(pieces.alias("pieces"), spans.alias("spans"), F.length(text).alias("size")), whole)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced, and n_chars (if there is one) counted anew. Only texts with spans are
    shuffled (and a few others)."""
    spans = materialize(personal_data(docs).filter(F.size("spans") > 0).select("key", "spans").distinct(), "redactions")
    clear, others = flagged(docs, row_key(docs["doc_id"], docs["text"]), spans)
    text = F.col("row")["text"]
    new = others.join(spans, "key", "left").withColumn("new", F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans"))))
    columns = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return clear.select("row.*").unionByName(new.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns]))
