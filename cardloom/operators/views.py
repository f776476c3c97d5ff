"""Views of a collection: facets and a text query compiled to one predicate, six orders, facet counts, URL form."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.functions.text import LOOSE_SET_NUMBER, locale_order, mana_bucket
from cardloom.operators.vectors import places

RARITIES = ("mythic", "rare", "uncommon", "common")
SORTS = ("date", "name", "set", "release", "mana", "rarity")
_OWN = {"date": (), "name": (), "set": ("set_code",), "release": ("released_at",), "mana": ("mana_value",), "rarity": ("rarity",)}
#: What each order reads.
SORT_COLUMNS = {sort: (*own, *(() if sort == "date" else ("name",)), "created_at", "ord") for sort, own in _OWN.items()}
LISTS = ("sets", "colors", "types", "mana", "rarities", "artists")
#: Names in a URL, in the order in which they are written.
URL_NAMES = {"sets": "set", "colors": "color", "types": "type", "mana": "mv", "rarities": "rarity", "artists": "artist"}


@dataclass(frozen=True)
class View:
    sets: tuple[str, ...] = ()
    colors: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    mana: tuple[str, ...] = ()
    rarities: tuple[str, ...] = ()
    artists: tuple[str, ...] = ()
    foil: str = "any"
    multiples: bool = False
    attention: bool = False
    query: str = ""
    sort: str = "date"
    more: dict = field(default_factory=dict, compare=False)


def _any(conditions: list[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, conditions), F.lit(False))


def filter_color(wanted) -> Column:
    c = F.col("colors")
    one = {"C": c == "", "M": F.length(c) >= 2}
    return _any([one[w] if w in one else F.contains(c, F.lit(w)) for w in wanted])


def filter_type(wanted) -> Column:
    return _any([F.contains(F.lower("type_line"), F.lit(w.lower())) for w in wanted])


def filter_mana(wanted) -> Column:
    return F.coalesce(mana_bucket(F.col("mana_value")).isin(*wanted), F.lit(False))


def filter_facets(view: View) -> Column:
    """All facets; null attributes fit none that is in use."""
    parts = [F.lit(True)]
    for values, column in ((view.sets, "set_code"), (view.rarities, "rarity"), (view.artists, "artist")):
        if values:
            parts.append(F.coalesce(F.col(column).isin(*values), F.lit(False)))
    if view.colors:
        parts.append(filter_color(view.colors))
    if view.types:
        parts.append(filter_type(view.types))
    if view.mana:
        parts.append(filter_mana(view.mana))
    if view.foil != "any":
        parts.append(F.col("foil") == F.lit(view.foil == "foil"))
    if view.multiples:
        parts.append(F.col("count") >= 2)
    if view.attention:
        parts.append(F.col("scryfall_id").isNull())
    return reduce(lambda a, b: a & b, parts)


def match_query(query: str) -> Column:
    """Name or set name contains it, set code starts with it, or ``set number`` with that code and number prefix."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    parts = [F.contains(F.lower("name"), F.lit(q)), F.startswith(F.lower("set_code"), F.lit(q)), F.contains(F.lower("set_name"), F.lit(q))]
    if m := re.match(LOOSE_SET_NUMBER.replace("(?i)", ""), q, re.IGNORECASE):
        parts.append((F.lower("set_code") == m[1]) & F.startswith(F.lower("collector_number"), F.lit(m[2])))
    return _any(parts)


def sort_keys(sort: str) -> list[Column]:
    """Names and codes compare as a reader's language has them; what is equal in the order stays newest first."""
    name = [locale_order(F.col("name")).asc()]
    newest = [F.desc("created_at"), F.desc("ord")]
    rank = reduce(lambda acc, r: F.when(F.col("rarity") == r[1], r[0]).otherwise(acc), list(enumerate(RARITIES)), F.lit(len(RARITIES)))
    first = {
        "date": [], "name": name, "set": [locale_order(F.coalesce("set_code", F.lit(""))).asc(), *name], "release": [F.col("released_at").desc_nulls_last(), *name],
        "mana": [F.col("mana_value").asc_nulls_last(), *name], "rarity": [rank.asc(), *name],
    }
    return first[sort if sort in first else "date"] + newest


def apply_view(cards: DataFrame, view: View) -> DataFrame:
    """The cards that fit, with their place in the view's order."""
    return places(cards.filter(filter_facets(view) & match_query(view.query)), *sort_keys(view.sort))


def visible_total(cards: DataFrame, view: View) -> DataFrame:
    shown = filter_facets(view) & match_query(view.query)
    return cards.agg(F.count("*").alias("total"), F.count_if(shown).alias("visible"))


def facet_sets(cards: DataFrame) -> DataFrame:
    """Rows per set code, with the first row's set name, or the code in capitals, as label."""
    return _sets(cards).drop("first")


def _sets(cards: DataFrame) -> DataFrame:
    rows = cards.filter(F.coalesce("set_code", F.lit("")) != "")
    each = rows.groupBy(F.col("set_code").alias("value")).agg(F.count("*").alias("n"), F.min_by("set_name", "ord").alias("label"), F.min("ord").alias("first"))
    return each.select("value", F.coalesce("label", F.upper("value")).alias("label"), "n", "first")


def set_options(cards: DataFrame) -> DataFrame:
    """``facet_sets`` in order of label, with their place; of equal labels the one whose row came first."""
    return places(_sets(cards), locale_order(F.col("label")), "first").drop("first")


def facet_artists(cards: DataFrame) -> DataFrame:
    rows = cards.filter(F.coalesce("artist", F.lit("")) != "")
    return rows.groupBy(F.col("artist").alias("value")).agg(F.count("*").alias("n"))


def artist_options(cards: DataFrame) -> DataFrame:
    """``facet_artists``, the most frequent first, then in order of name, with their place."""
    rows = cards.filter(F.coalesce("artist", F.lit("")) != "")
    each = rows.groupBy(F.col("artist").alias("value")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return places(each, F.desc("n"), locale_order(F.col("value")), "first").drop("first")


def filter_options(options: DataFrame, text: str) -> DataFrame:
    """Options whose value or label holds the text; blank text keeps all."""
    t = text.strip().lower()
    return options if not t else options.filter(_any([F.contains(F.lower(c), F.lit(t)) for c in ("value", "label") if c in options.columns]))


def alternatives(candidates: DataFrame, chosen: str = "chosen") -> DataFrame:
    """Candidates other than the chosen row."""
    return candidates.filter(~F.col("scryfall_id").eqNullSafe(F.col(chosen)))


def _argument(url: Column, name: str) -> Column:
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.try_url_decode(raw)


def parse_view_urls(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``view``: lists split at commas without blanks, flags, query and sort, with defaults for what is odd."""
    u = F.col(url)
    lists = [F.filter(F.split(F.coalesce(_argument(u, name), F.lit("")), ","), lambda x: x != "").alias(key) for key, name in URL_NAMES.items()]
    foil, sort = _argument(u, "foil"), _argument(u, "sort")
    return rows.withColumn(
        "view",
        F.struct(
            *lists, F.when(foil.isin("foil", "nonfoil"), foil).otherwise("any").alias("foil"), F.coalesce(_argument(u, "copies") == "multi", F.lit(False)).alias("multiples"),
            F.coalesce(_argument(u, "attention") == "1", F.lit(False)).alias("attention"), F.coalesce(_argument(u, "q"), F.lit("")).alias("query"),
            F.when(sort.isin(*SORTS), sort).otherwise("date").alias("sort"),
        ),
    )


def serialize_view(view: str = "view") -> Column:
    """The query string of a view; what is at its default is left out."""
    v = lambda name: F.col(f"{view}.{name}")
    parts = [F.when(F.size(v(key)) > 0, F.concat(F.lit(f"{name}="), F.url_encode(F.array_join(v(key), ",")))) for key, name in URL_NAMES.items()]
    parts += [
        F.when(v("foil") != "any", F.concat(F.lit("foil="), v("foil"))), F.when(v("multiples"), "copies=multi"), F.when(v("attention"), "attention=1"),
        F.when(v("query") != "", F.concat(F.lit("q="), F.url_encode(v("query")))), F.when(v("sort") != "date", F.concat(F.lit("sort="), v("sort"))),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "&")


def active_filter_count(view: str = "view") -> Column:
    v = lambda name: F.col(f"{view}.{name}")
    used = [F.size(v(key)) > 0 for key in LISTS] + [v("foil") != "any", v("multiples"), v("attention")]
    return reduce(lambda a, b: a + b, [u.cast("int") for u in used])


def active_chips(rows: DataFrame, view: str = "view") -> DataFrame:
    """One row per value in use, in fixed order: place, facet, value."""
    v = lambda name: F.col(f"{view}.{name}")
    chip = lambda facet: lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value"))
    flag = lambda on, facet, value: F.when(on, F.array(F.struct(F.lit(facet).alias("facet"), value.alias("value")))).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))
    chips = [F.transform(v(k), chip(k)) for k in LISTS] + [flag(v("foil") != "any", "foil", v("foil")), flag(v("multiples"), "multiples", F.lit("2+")), flag(v("attention"), "attention", F.lit("yes"))]
    return rows.select("*", F.posexplode(F.concat(*chips)).alias("place", "chip")).select(*rows.columns, "place", "chip.facet", "chip.value")
