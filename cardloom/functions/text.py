"""Scalar functions over text, numbers and time, as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Names of languages in collection files, and their codes.
LANGUAGES = {
    "english": "en", "spanish": "es", "french": "fr", "german": "de", "italian": "it", "portuguese": "pt",
    "japanese": "ja", "korean": "ko", "russian": "ru", "chinese simplified": "zhs", "chinese traditional": "zht", "phyrexian": "ph",
}
# Colours in their order, and the forms of set numbers, ids and times in files.
COLORS = ("W", "U", "B", "R", "G")
SET_NUMBER = r"(?i)^([a-z0-9]{2,6})(?:[\s/#:]+|-(?=\d))([a-z0-9★†-]+)$"
LOOSE_SET_NUMBER = r"(?i)^([a-z0-9]{2,6})[\s/#:]+(\S+)$"
CARD_ID = r"\A[A-Za-z0-9][A-Za-z0-9_-]{0,63}\z"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?$"


def color_string(colors: Column) -> Column:
    """Colours in a fixed order, each once; null or none is empty."""
    known = F.filter(F.array(*[F.lit(c) for c in COLORS]), lambda c: F.array_contains(colors, c))
    return F.when(colors.isNull(), "").otherwise(F.array_join(known, ""))


def image_filename(set_code: Column, number: Column, face_index: Column) -> Column:
    face = F.when(face_index > 0, F.concat(F.lit("_face"), face_index)).otherwise("")
    return F.concat(set_code, F.lit("-"), F.regexp_replace(number, r"[^\p{L}\p{N}]", "_"), face, F.lit(".jpg"))


def image_url(base: str, item_id: Column, size: str = "normal") -> Column:
    """By the first two characters of the id."""
    return F.concat(F.lit(f"{base}/{size}/front/"), F.substring(item_id, 1, 1), F.lit("/"), F.substring(item_id, 2, 1), F.lit("/"), item_id, F.lit(".jpg"))


def photo_url(card_id: Column, version: Column) -> Column:
    return F.concat(F.lit("/api/cards/"), card_id, F.lit("/image?v="), F.url_encode(version))


def search_rank(name: Column, query: Column) -> Column:
    """0 equal, 1 prefix, 2 at a word's start, 3 inside, -1 not at all; both lower-cased by the caller."""
    return F.when(name == query, 0).when(F.startswith(name, query), 1).when(F.contains(name, F.concat(F.lit(" "), query)), 2).when(F.contains(name, query), 3).otherwise(-1)


def parse_set_number(query: Column, pattern: str = SET_NUMBER) -> Column:
    """struct(code, number), lower-cased code; null where the text isn't of that form."""
    hit = query.rlike(pattern)
    return F.when(hit, F.struct(F.lower(F.regexp_extract(query, pattern, 1)).alias("code"), F.regexp_extract(query, pattern, 2).alias("number")))


def number_key(set_code: Column, number: Column) -> Column:
    return F.concat(F.lower(set_code), F.lit("|"), F.lower(number))


def mana_bucket(value: Column) -> Column:
    return F.when(value >= 6, "6+").otherwise(F.floor(value).cast("string"))


def language_code(name: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.coalesce(F.element_at(pairs, F.lower(F.trim(name))), F.lit("en"))


def parse_timestamp(value: Column) -> Column:
    """``date time`` or ``dateTtime``, fraction cut to milliseconds; everything else, words included, is null."""
    cut = F.regexp_replace(F.replace(value, F.lit("T"), F.lit(" ")), r"(\.\d{1,3})\d*$", "$1")
    return F.when(value.rlike(TIMESTAMP), F.try_to_timestamp(cut))


def format_timestamp(value: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("000")), F.lit(""))


def csv_field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def placeholder_key(name: Column, set_code: Column, number: Column, foil: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lower(part(name)), F.lit("|"), part(set_code), F.lit("|"), part(number), F.lit("|"), part(foil))


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""))


def sanitize(name: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s-]", ""), r"(?U)\s+", "_"), 1, most)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def parse_corners(text: Column) -> Column:
    """``x,y;x,y`` to an array of points; blank or malformed text is null."""
    points = F.transform(F.split(text, ";"), lambda p: F.struct(F.get(F.split(p, ","), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(p, ","), F.lit(1)).try_cast("double").alias("y")))
    bad = F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull()) | F.exists(F.split(text, ";"), lambda p: F.size(F.split(p, ",")) != 2)
    return F.when((F.trim(text) != "") & ~bad, points)


def format_corners(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat(F.format_string("%.1f", p["x"]), F.lit(","), F.format_string("%.1f", p["y"]))), ";")


def _by_value(text: Column, other) -> Column:
    """Text with its runs of digits in a form that sorts by value, however long."""
    by_value = lambda digits: F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), by_value(F.regexp_replace(p, "^0+(?=[0-9])", ""))).otherwise(other(p))), "")


def natural_key(text: Column) -> Column:
    """Equal where texts differ in case alone, and sorts runs of digits by value; other characters by their code."""
    return _by_value(text, F.lower)


def locale_order(text: Column) -> Column:
    """Sorts as a reader's language does: letters before their case and accents, punctuation and digits before letters."""
    return F.collate(text, "UNICODE")


def natural_order(text: Column) -> Column:
    """As ``locale_order``, without case and accents, and with runs of digits by value."""
    return F.collate(_by_value(text, lambda p: p), "UNICODE_CI_AI")


def valid_card_id(card_id: Column) -> Column:
    return F.coalesce(card_id.rlike(CARD_ID), F.lit(False))


def new_card_id(*key: Column) -> Column:
    """An id made from the key, so that a repeated run makes the same one."""
    return F.substring(F.sha2(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("")) for k in key]), 256), 1, 32)


#: Cells of the comparison tables that are held at once.
TABLE = 1 << 18
#: No character.
_NONE = np.uint32(0xFFFFFFFF)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as rows of code points, filled up with zeros, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(sizes.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, sizes


def _popular(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Characters of long second texts that occur too often to begin a block: more than one in a hundred, in 200 or more."""
    out = np.zeros(codes.shape, bool)
    for k in np.flatnonzero(sizes >= 200).tolist():
        kinds, at, times = np.unique(codes[k, : sizes[k]], return_inverse=True, return_counts=True)
        out[k, : sizes[k]] = (times > sizes[k] // 100 + 1)[at]
    return out


def _longest(a: np.ndarray, b: np.ndarray, usable: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parts (row, a from, a to, b from, b to), the longest in the first text first: where the longest equal run begins in both, the first of equals, and its
    length.  One step compares a character of every part's first text with all of its second."""
    row, a0, a1, b0, b1 = parts.T
    width = int((b1 - b0).max())
    at = b0[:, None] + np.arange(width)
    ok = at < b1[:, None]
    at = np.minimum(at, b.shape[1] - 1)
    ok &= usable[row[:, None], at]
    other = np.where(ok, b[row[:, None], at], _NONE)
    run = np.zeros((len(parts), width + 1), np.int32)
    size, end_a, end_b = np.zeros(len(parts), np.int64), a0.copy(), b0.copy()
    lengths = a1 - a0
    live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")  # parts with a character at each step
    for k, n in enumerate(live.tolist()):
        own = run[:n]
        grown = own[:, :-1] + 1
        grown *= other[:n] == a[row[:n], a0[:n] + k][:, None]
        own[:, 1:] = grown
        best = grown.argmax(axis=1)
        length = grown[np.arange(n), best]
        better = np.flatnonzero(length > size[:n])
        size[better], end_a[better], end_b[better] = length[better], a0[better] + k + 1, (b0[:n] + best + 1)[better]
    begin_a, begin_b = end_a - size, end_b - size
    while True:  # characters that can't begin a block still lengthen one
        can = (begin_a > a0) & (begin_b > b0)
        can[can] = a[row[can], begin_a[can] - 1] == b[row[can], begin_b[can] - 1]
        begin_a, begin_b, size = begin_a - can, begin_b - can, size + can
        more = (begin_a + size < a1) & (begin_b + size < b1)
        more[more] = a[row[more], (begin_a + size)[more]] == b[row[more], (begin_b + size)[more]]
        size = size + more
        if not (can | more).any():
            return begin_a, begin_b, size


def matching_share(first: list[str], second: list[str]) -> np.ndarray:
    """For each pair of texts, twice the characters in matching blocks over those of both: the longest equal run, then the
    longest left and right of it, and so on.  All pairs advance together, a table of steps at a time."""
    a, la = _codes(first)
    b, lb = _codes(second)
    usable = ~_popular(b, lb)
    matched = np.zeros(len(first), np.int64)
    parts = np.stack([np.arange(len(first)), np.zeros_like(la), la, np.zeros_like(lb), lb], axis=1)
    while True:
        parts = parts[(parts[:, 2] > parts[:, 1]) & (parts[:, 4] > parts[:, 3])]
        if not len(parts):
            break
        # Tables of parts about as wide, the longest first, so that steps get narrower as parts end.
        wide = np.ceil(np.log2(parts[:, 4] - parts[:, 3])).astype(np.int64)
        parts = parts[np.lexsort((parts[:, 1] - parts[:, 2], wide))]
        edges = np.flatnonzero(np.diff(np.sort(wide))) + 1
        rest = []
        for own in np.split(parts, edges):
            most = max(1, TABLE // int((own[:, 4] - own[:, 3]).max()))
            for block in (own[k : k + most] for k in range(0, len(own), most)):
                i, j, n = _longest(a, b, usable, block)
                np.add.at(matched, block[:, 0], n)
                found, i, j, n = block[n > 0], i[n > 0], j[n > 0], n[n > 0]
                rest += [np.stack([found[:, 0], found[:, 1], i, found[:, 3], j], axis=1), np.stack([found[:, 0], i + n, found[:, 2], j + n, found[:, 4]], axis=1)]
        parts = np.concatenate(rest)
    both = la + lb
    return np.where(both > 0, 2.0 * matched / np.where(both > 0, both, 1), 1.0)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Each different pair of a batch once; pairs with a null stay open."""
    pairs = pd.DataFrame({"a": a, "b": b}).dropna()
    out = pd.Series(np.nan, index=a.index, dtype="float64")
    if len(pairs):
        each = pairs.drop_duplicates()
        known = each.assign(r=matching_share(each["a"].tolist(), each["b"].tolist()))
        out[pairs.index] = pairs.merge(known, on=["a", "b"], how="left")["r"].to_numpy()
    return out


def _most(a: Column, b: Column) -> Column:
    """The largest ratio that two texts' lengths and letters allow."""
    n = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.lit(0), lambda s, c: s + F.least(n(a, c), n(b, c)))
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(2.0 * common / both)


def fuzzy_ratio(a: Column | str, b: Column | str, least: Column | None = None) -> Column:
    """How much of two texts is in matching blocks; null where either is. With ``least``, a ratio that can't reach it is 0.
    Lengths and letters, counted in the JVM, decide about most pairs then, and equal texts; only the others' texts are
    looked at, whole batches at a time."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    null = a.isNull() | b.isNull()
    decided = F.when(null, F.lit(None).cast("double")).when(a == b, 1.0)
    if least is not None:
        decided = decided.when(_most(a, b) < least, 0.0)
    open_ = ~null & (a != b) if least is None else ~null & (a != b) & (_most(a, b) >= least)
    return F.coalesce(decided, _ratio(F.when(open_, a), F.when(open_, b)))
