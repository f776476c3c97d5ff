"""Views, facets, text search and view URLs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardloom.operators import catalog as C
from cardloom.operators import search as S
from cardloom.operators import views as V
from cardloom.operators.vectors import places
from cardloom.plans import tables as T
from cardloom.plans.registry import query
from cardloom.sources.shared import kept, made_once

CARDS = "WITH " + T.LIBRARY_SQL + ", " + T.CATALOG_SQL + """, cards AS (SELECT h.*, c.artist, c.type_line, c.rarity, c.set_name, c.colors, c.mana_value, c.released_at, h.photo IS NOT NULL AS has_photo
  FROM held h LEFT JOIN cat c ON c.scryfall_id = h.scryfall_id)"""


def cards(spark, sf):
    held, _ = T.held_and_batch(spark, sf)
    return C.enrich_library(held, T.catalog(spark, sf), held.filter("photo is not null").select("card_id"))


def ids(where: str) -> str:
    return CARDS + f" SELECT card_id FROM cards WHERE {where}"


@query("enrich_library", CARDS + " SELECT card_id, artist, type_line, rarity, set_name, colors, mana_value, released_at, has_photo FROM cards")
def enrich_library(spark, sf):
    return cards(spark, sf).select("card_id", *C.ATTRIBUTES, "has_photo")


@query("has_photo", CARDS + " SELECT card_id, has_photo FROM cards")
def has_photo(spark, sf):
    return cards(spark, sf).select("card_id", "has_photo")


VIEW = V.View(sets=("b1", "b2", "b3"), rarities=("rare", "mythic"), foil="nonfoil", multiples=True)
VIEW_SQL = "set_code IN ('b1', 'b2', 'b3') AND rarity IN ('rare', 'mythic') AND NOT foil AND count >= 2"


@query("filter_view", ids(VIEW_SQL))
def filter_view(spark, sf):
    return cards(spark, sf).filter(V.filter_facets(VIEW)).select("card_id")


@query("filter_color", ids("colors = '' OR length(colors) >= 2 OR contains(colors, 'G')"))
def filter_color(spark, sf):
    return cards(spark, sf).filter(V.filter_color(("C", "M", "G"))).select("card_id")


@query("filter_type", ids("contains(lower(type_line), 'econ') OR contains(lower(type_line), 'small')"))
def filter_type(spark, sf):
    return cards(spark, sf).filter(V.filter_type(("Econ", "small"))).select("card_id")


@query("filter_mana", ids("mana_value >= 6 OR floor(mana_value) = 2"))
def filter_mana(spark, sf):
    return cards(spark, sf).filter(V.filter_mana(("6+", "2"))).select("card_id")


@query("match_query", ids("contains(lower(name), '12') OR starts_with(lower(set_code), '12') OR contains(lower(set_name), '12')"))
def match_query(spark, sf):
    return cards(spark, sf).filter(V.match_query(" 12 ")).select("card_id")


@query("apply_view", CARDS + f", v AS (SELECT * FROM cards WHERE {VIEW_SQL} AND (contains(lower(name), '1') OR starts_with(lower(set_code), '1') OR contains(lower(set_name), '1'))) SELECT card_id, row_number() OVER (ORDER BY created_at DESC, ord DESC) AS place FROM v")
def apply_view(spark, sf):
    return V.apply_view(cards(spark, sf), V.View(**{**VIEW.__dict__, "query": "1"})).select("card_id", "place")


@query("visible_total", CARDS + f" SELECT count(*) AS total, count_if({VIEW_SQL}) AS visible FROM cards")
def visible_total(spark, sf):
    return V.visible_total(cards(spark, sf), VIEW)


RANK = "CASE rarity WHEN 'mythic' THEN 0 WHEN 'rare' THEN 1 WHEN 'uncommon' THEN 2 WHEN 'common' THEN 3 ELSE 4 END"
KEY = "icu_sort_key(name, 'en')"
ORDERS = {
    "date": "", "name": f"{KEY}, ", "set": f"icu_sort_key(coalesce(set_code, ''), 'en'), {KEY}, ", "release": f"released_at DESC NULLS LAST, {KEY}, ",
    "mana": f"mana_value NULLS LAST, {KEY}, ", "rarity": f"{RANK}, {KEY}, ",
}


@query("sort_view", CARDS + " " + " UNION ALL ".join(f"SELECT '{k}' AS sort, card_id, row_number() OVER (ORDER BY {v}created_at DESC, ord DESC) AS place FROM cards" for k, v in ORDERS.items()))
def sort_view(spark, sf):
    """All cards in each of the six orders. Photos aren't looked up, as no order asks for them, and each order shuffles its
    own columns alone."""
    held, _ = T.held_and_batch(spark, sf)
    needed = sorted({c for columns in V.SORT_COLUMNS.values() for c in columns})
    rows, out = kept(C.with_attributes(held, T.catalog(spark, sf)).select("card_id", *needed), "cards"), None
    for sort in V.SORTS:
        narrow = rows.select("card_id", *V.SORT_COLUMNS[sort])
        placed = places(narrow, *V.sort_keys(sort), columns=("card_id",)).select(F.lit(sort).alias("sort"), "card_id", "place")
        out = placed if out is None else out.unionByName(placed)
    return out


# Names and labels with accents, capitals, punctuation and numbers, in Spark and in SQL.
ACCENTED = """CASE {k} % 6 WHEN 0 THEN replace({c}, 'e', 'é') WHEN 1 THEN upper({c}) WHEN 2 THEN replace({c}, 'o', 'ö') WHEN 3 THEN replace({c}, ' ', '-') WHEN 4 THEN {c} ELSE replace({c}, 'a', 'Å') END || ' ' || ({k} % 30)"""


def accented(column, key):
    c = F.col(column)
    e = lambda a, b: F.replace(c, F.lit(a), F.lit(b))
    turned = F.when(key % 6 == 0, e("e", "é")).when(key % 6 == 1, F.upper(c)).when(key % 6 == 2, e("o", "ö")).when(key % 6 == 3, e(" ", "-")).when(key % 6 == 4, c).otherwise(e("a", "Å"))
    return F.concat(turned, F.lit(" "), (key % 30).cast("string"))


def accented_cards(spark, sf):
    """Cards under their part's name, with labels and artists made of names too."""
    part = F.col("scryfall_id").cast("long")
    names = T.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("scryfall_id"), F.col("p_name").alias("part_name"))
    rows = cards(spark, sf).filter("scryfall_id is not null").join(names, "scryfall_id")
    word = F.substring_index("part_name", " ", 1)
    rows = rows.withColumns({"name": accented("part_name", part), "word": word}).withColumns({"set_name": accented("word", F.substring("set_code", 2, 9).cast("long") % 6), "artist": accented("word", part % 6)})
    return rows.drop("part_name", "word")


ACCENTED_SQL = CARDS.replace("cards AS (", "cards0 AS (", 1) + f""", a0 AS (SELECT c.*, p_name, split_part(p_name, ' ', 1) AS word, p_partkey AS part FROM cards0 c JOIN part ON CAST(p_partkey AS VARCHAR) = c.scryfall_id),
cards AS (SELECT * EXCLUDE (name, set_name, artist), {ACCENTED.format(c='p_name', k='part')} AS name, {ACCENTED.format(c='word', k='(part % 6)')} AS artist, {ACCENTED.format(c='word', k="(CAST(substr(set_code, 2) AS BIGINT) % 6)")} AS set_name FROM a0)"""


@query("sort_view_accented", ACCENTED_SQL + " SELECT card_id, row_number() OVER (ORDER BY icu_sort_key(name, 'en'), created_at DESC, ord DESC) AS place FROM cards")
def sort_view_accented(spark, sf):
    return places(accented_cards(spark, sf), *V.sort_keys("name")).select("card_id", "place")


@query("set_options", ACCENTED_SQL + """, o AS (SELECT set_code AS value, arg_min(set_name, ord) AS label, count(*) AS n, min(ord) AS first FROM cards GROUP BY set_code)
SELECT value, label, n, row_number() OVER (ORDER BY icu_sort_key(label, 'en'), first) AS place FROM o""")
def set_options(spark, sf):
    return V.set_options(accented_cards(spark, sf))


@query("artist_options", ACCENTED_SQL + """, o AS (SELECT artist AS value, count(*) AS n, min(ord) AS first FROM cards GROUP BY artist)
SELECT value, n, row_number() OVER (ORDER BY n DESC, icu_sort_key(value, 'en'), first) AS place FROM o""")
def artist_options(spark, sf):
    return V.artist_options(accented_cards(spark, sf))


@query("facet_sets", CARDS + " SELECT set_code AS value, coalesce(arg_min_null(set_name, ord), upper(set_code)) AS label, count(*) AS n FROM cards WHERE coalesce(set_code, '') <> '' GROUP BY set_code")
def facet_sets(spark, sf):
    return V.facet_sets(cards(spark, sf))


@query("facet_artists", CARDS + " SELECT artist AS value, count(*) AS n FROM cards WHERE coalesce(artist, '') <> '' GROUP BY artist")
def facet_artists(spark, sf):
    return V.facet_artists(cards(spark, sf))


@query("filter_options", CARDS + " SELECT artist AS value, count(*) AS n FROM cards WHERE contains(lower(artist), 'ist 3') GROUP BY artist")
def filter_options(spark, sf):
    return V.filter_options(V.facet_artists(cards(spark, sf)), " IST 3")


@query("alternatives", "WITH " + T.CATALOG_SQL + " SELECT a.pos AS a, b.scryfall_id FROM cat a JOIN cat b ON a.set_code = b.set_code AND a.collector_number = b.collector_number AND a.scryfall_id <> b.scryfall_id")
def alternatives(spark, sf):
    cat = T.catalog(spark, sf)
    chosen = cat.select("pos", F.col("scryfall_id").alias("chosen"), "set_code", "collector_number")
    same = C.dealt_join(chosen, cat.select("scryfall_id", "set_code", "collector_number"), ["set_code", "collector_number"], "pos")
    return V.alternatives(same).select(F.col("pos").alias("a"), "scryfall_id")


# Queries of a search: every part whose number ends in 0 is looked for by the start of its name, and by set and number.
QUERIES = """, q AS (SELECT pos AS query_id, substr(name, 1, 4) AS q, NULL AS code, NULL AS num FROM cat WHERE pos % 50 = 0 UNION ALL SELECT pos + 1000000, lower(set_code) || ' ' || collector_number, lower(set_code), collector_number FROM cat WHERE pos % 50 = 0)"""
FOUND = QUERIES + """, n AS (SELECT q.query_id, c.*, CASE WHEN coalesce(c.lang, 'en') = 'en' THEN -2 ELSE -1 END AS match FROM q JOIN cat c ON lower(c.set_code) = q.code AND lower(c.collector_number) = q.num
  QUALIFY row_number() OVER (PARTITION BY q.query_id, c.scryfall_id ORDER BY c.pos) = 1),
t AS (SELECT q.query_id, c.*, CASE WHEN lower(c.name) = q.q THEN 0 WHEN starts_with(lower(c.name), q.q) THEN 1 WHEN contains(lower(c.name), ' ' || q.q) THEN 2 ELSE 3 END AS match
  FROM (SELECT query_id, lower(trim(q)) AS q FROM q WHERE length(trim(q)) >= 2) q JOIN cat c ON contains(lower(c.name), q.q) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.query_id = q.query_id AND n.scryfall_id = c.scryfall_id)),
f AS (SELECT * FROM n UNION ALL SELECT * FROM t), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match, CASE WHEN match >= 0 THEN lower(name) END, CASE WHEN match >= 0 THEN CAST(substr(set_code, 2) AS INTEGER) END,
  CASE WHEN match >= 0 THEN CAST(collector_number AS INTEGER) END, pos) AS place FROM f)"""


def searches(spark, sf):
    cat = T.catalog(spark, sf).filter("pos % 50 = 0")
    names = cat.select(F.col("pos").alias("query_id"), F.substring("name", 1, 4).alias("query"))
    return names.unionByName(cat.select((F.col("pos") + 1000000).alias("query_id"), F.concat("set_code", F.lit(" "), "collector_number").alias("query")))


def name_index(spark, sf, kind="plain", catalog=T.catalog):
    """The index of a catalogue, which the application builds once."""
    return S.open_name_index(spark, made_once(spark, "names", (sf, kind), lambda path: S.build_name_index(catalog(spark, sf), path)))


@query("name_search", "WITH " + T.CATALOG_SQL + FOUND + " SELECT query_id, place, pos FROM z WHERE place <= 50")
def name_search(spark, sf):
    return S.search_names(searches(spark, sf), name_index(spark, sf)).select("query_id", "place", "pos")


NATURAL = "icu_sort_key(regexp_replace(strip_accents(lower({})), ' ([0-9])$', ' 0\\1'), 'en')"
ACCENTED_CATALOG = "WITH " + T.CATALOG_SQL.replace("cat AS (", "cat0 AS (", 1) + f", cat AS (SELECT * EXCLUDE (name), {ACCENTED.format(c='name', k='pos')} AS name FROM cat0)"


def accented_catalog(spark, sf):
    return T.catalog(spark, sf).withColumn("name", accented("name", F.col("pos")))


@query("name_search_accented", ACCENTED_CATALOG + FOUND.replace("CASE WHEN match >= 0 THEN lower(name) END", "CASE WHEN match >= 0 THEN " + NATURAL.format("name") + " END") + " SELECT query_id, place, pos FROM z WHERE place <= 50")
def name_search_accented(spark, sf):
    """Searches among names with accents, capitals and numbers, which come in a reader's order."""
    index = name_index(spark, sf, "accented", accented_catalog)
    cat = accented_catalog(spark, sf).filter("pos % 50 = 0")
    names = cat.select(F.col("pos").alias("query_id"), F.substring("name", 1, 4).alias("query"))
    asked = names.unionByName(cat.select((F.col("pos") + 1000000).alias("query_id"), F.concat("set_code", F.lit(" "), "collector_number").alias("query")))
    return S.search_names(asked, index).select("query_id", "place", "pos")


@query("number_then_name", "WITH " + T.CATALOG_SQL + FOUND + " SELECT query_id, count(*) AS n FROM z GROUP BY query_id")
def number_then_name(spark, sf):
    return S.count_found(searches(spark, sf), name_index(spark, sf))


@query("search_order", "WITH " + T.CATALOG_SQL + " SELECT pos, row_number() OVER (PARTITION BY set_code ORDER BY lower(name), lpad(collector_number, 18, '0'), pos) AS place FROM cat")
def search_order(spark, sf):
    from cardloom.functions.text import natural_key

    order = Window.partitionBy("set_code").orderBy(natural_key(F.col("name")), natural_key(F.col("collector_number")), "pos")
    return T.catalog(spark, sf).select("pos", F.row_number().over(order).alias("place"))


@query("limit_results", "WITH " + T.CATALOG_SQL + " SELECT set_code, pos FROM cat QUALIFY row_number() OVER (PARTITION BY set_code ORDER BY pos) <= 12")
def limit_results(spark, sf):
    place = F.row_number().over(Window.partitionBy("set_code").orderBy("pos"))
    return T.catalog(spark, sf).withColumn("p", place).filter("p <= 12").select("set_code", "pos")


@query("public_fields", "WITH " + T.CATALOG_SQL + " SELECT scryfall_id, name, set_code, collector_number, set_name FROM cat")
def public_fields(spark, sf):
    return S.public_fields(T.catalog(spark, sf))


URLS = """u AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END AS u FROM (SELECT page_id, regexp_extract(url, '^[^#]*') AS url FROM pages)),
full_url AS (SELECT page_id, u || 'set=a' || page_id % 3 || ',,b&sort=' || CASE page_id % 2 WHEN 0 THEN 'name' ELSE 'odd' END || '&foil=' || CASE page_id % 3 WHEN 0 THEN 'foil' ELSE 'x' END || '&copies=multi&q=two+words' AS url FROM u)"""


def view_urls(spark, sf):
    p = F.col("page_id")
    bare = F.regexp_extract("url", "^[^#]*", 0)
    rest = F.concat(F.lit("set=a"), p % 3, F.lit(",,b&sort="), F.when(p % 2 == 0, "name").otherwise("odd"), F.lit("&foil="), F.when(p % 3 == 0, "foil").otherwise("x"), F.lit("&copies=multi&q=two+words"))
    return T.table(spark, sf, "pages").select("page_id", F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), rest).alias("url"))


@query("parse_view_url", "WITH " + URLS + " SELECT page_id, ['a' || page_id % 3, 'b'] AS sets, CASE page_id % 3 WHEN 0 THEN 'foil' ELSE 'any' END AS foil, true AS multiples, false AS attention, 'two words' AS query, CASE page_id % 2 WHEN 0 THEN 'name' ELSE 'date' END AS sort FROM full_url")
def parse_view_url(spark, sf):
    return V.parse_view_urls(view_urls(spark, sf)).select("page_id", "view.sets", "view.foil", "view.multiples", "view.attention", "view.query", "view.sort")


@query("serialize_view", "WITH " + URLS + " SELECT page_id, 'set=a' || page_id % 3 || '%2Cb' || CASE page_id % 3 WHEN 0 THEN '&foil=foil' ELSE '' END || '&copies=multi&q=two+words' || CASE page_id % 2 WHEN 0 THEN '&sort=name' ELSE '' END AS query FROM full_url")
def serialize_view(spark, sf):
    return V.parse_view_urls(view_urls(spark, sf)).select("page_id", V.serialize_view().alias("query"))


@query("active_filter_count", "WITH " + URLS + " SELECT page_id, CASE page_id % 3 WHEN 0 THEN 3 ELSE 2 END AS n FROM full_url")
def active_filter_count(spark, sf):
    return V.parse_view_urls(view_urls(spark, sf)).select("page_id", V.active_filter_count().alias("n"))


@query("active_chips", "WITH " + URLS + """, c AS (SELECT page_id, 0 AS place, 'sets' AS facet, 'a' || page_id % 3 AS value FROM full_url UNION ALL SELECT page_id, 1, 'sets', 'b' FROM full_url
  UNION ALL SELECT page_id, 2, 'foil', 'foil' FROM full_url WHERE page_id % 3 = 0 UNION ALL SELECT page_id, CASE page_id % 3 WHEN 0 THEN 3 ELSE 2 END, 'multiples', '2+' FROM full_url) SELECT * FROM c""")
def active_chips(spark, sf):
    return V.active_chips(V.parse_view_urls(view_urls(spark, sf))).select("page_id", "place", "facet", "value")
