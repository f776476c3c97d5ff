"""Profiles of parts, documents and orders; sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardloom.operators import profile as P
from cardloom.operators import sampling as S
from cardloom.plans import tables as T
from cardloom.plans.registry import query

W = "WITH " + T.CATALOG_SQL


FRAME, BORDER = ("2015", "2003", "1997", "1993", "future", "2015", "other"), ("black", "white", "borderless", "gold", "silver", "yellow", "black", "black")
LAYOUT = (*S.LAYOUTS, "battle")
#: An effect stands where the number is divisible by its divisor.
EFFECT = {"legendary": 2, "showcase": 13, "extendedart": 17, "etched": 19, "inverted": 29, "snow": 31, "companion": 37, "enchantment": 41, "colorshifted": 43}


def faces(spark, sf):
    """Parts with the columns that categories are made of, so that each category has rows."""
    p = F.col("pos")
    nth = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))
    effects = F.array_compact(F.array(*[F.when(p % d == 0, e) for e, d in EFFECT.items()]))
    return T.catalog(spark, sf).select(
        "pos", "scryfall_id", F.element_at(F.split("name", " "), 1).alias("name"), "set_code", "collector_number", F.when(p % 47 != 0, effects).alias("frame_effects"),
        nth(FRAME, p).alias("frame"), nth(BORDER, F.floor(p / 7)).alias("border_color"), (p % 11 == 0).alias("full_art"), F.when(p % 3 == 0, nth(LAYOUT, F.floor(p / 3))).otherwise("normal").alias("layout"),
        F.when(p % 23 != 0, F.coalesce("rarity", F.lit("special"))).otherwise("bonus").alias("rarity"), (p % 5 % 3).cast("int").alias("face_index"), F.concat(F.lit("f"), p).alias("filename"),
    )


def _nth(values, i):
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({i} % {len(values)} + 1 AS INTEGER))"


FACES = W + f""", fc AS (SELECT pos, scryfall_id, split_part(name, ' ', 1) AS name, set_code, collector_number,
  CASE WHEN pos % 47 <> 0 THEN list_filter([{', '.join(f"CASE WHEN pos % {d} = 0 THEN '{e}' END" for e, d in EFFECT.items())}], lambda x: x IS NOT NULL) END AS frame_effects,
  {_nth(FRAME, 'pos')} AS frame, {_nth(BORDER, '(pos // 7)')} AS border_color, pos % 11 = 0 AS full_art, CASE WHEN pos % 3 = 0 THEN {_nth(LAYOUT, '(pos // 3)')} ELSE 'normal' END AS layout,
  CASE WHEN pos % 23 <> 0 THEN coalesce(rarity, 'special') ELSE 'bonus' END AS rarity, CAST(pos % 5 % 3 AS INTEGER) AS face_index, 'f' || pos AS filename FROM cat)"""


@query("value_counts_pct", W + """, u AS (SELECT 'rarity' AS dimension, rarity AS value FROM cat UNION ALL SELECT 'lang', lang FROM cat UNION ALL SELECT 'set_code', set_code FROM cat)
SELECT dimension, value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM cat), 4) AS pct FROM u WHERE value IS NOT NULL GROUP BY dimension, value""")
def value_counts_pct(spark, sf):
    return P.value_counts(T.catalog(spark, sf), "rarity", "lang", "set_code")


@query("counts_desc", W + " SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM (SELECT type_line AS value, count(*) AS n FROM cat GROUP BY type_line) QUALIFY place <= 20")
def counts_desc(spark, sf):
    top = P.counts_desc(T.catalog(spark, sf), "type_line", 20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


@query("effect_counts", FACES + ", e AS (SELECT unnest(frame_effects) AS effect FROM fc) SELECT effect, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM fc), 4) AS pct FROM e GROUP BY effect")
def effect_counts(spark, sf):
    return P.effect_counts(faces(spark, sf))


@query("multi_printing_thresholds", W + ", c AS (SELECT count(*) AS c FROM cat GROUP BY name) SELECT t, count_if(c >= t) AS names, round(100.0 * count_if(c >= t) / count(*), 4) AS pct FROM c, (VALUES (1), (2), (3), (5), (10), (20), (50)) x(t) GROUP BY t")
def multi_printing_thresholds(spark, sf):
    return P.multi_printing_thresholds(T.catalog(spark, sf))


@query("most_printed", W + " SELECT name, count(*) AS n FROM cat GROUP BY name ORDER BY n DESC, name LIMIT 20")
def most_printed(spark, sf):
    return P.most_printed(T.catalog(spark, sf))


@query("cross_counts", W + " SELECT rarity, set_code, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM cat), 4) AS pct FROM cat GROUP BY rarity, set_code")
def cross_counts(spark, sf):
    return P.cross_counts(T.catalog(spark, sf), "rarity", "set_code")


@query("set_diversity", W + ", c AS (SELECT count(*) AS n FROM cat GROUP BY set_code) SELECT count(*) AS sets, count_if(n = 1) AS single, count_if(n < 10) AS below_10, count_if(n >= 100) AS from_100, max(n) AS largest FROM c")
def set_diversity(spark, sf):
    return P.set_diversity(T.catalog(spark, sf))


@query("crosstab_margins", "SELECT coalesce(o_orderstatus, 'All') AS o_orderstatus, coalesce(o_orderpriority, 'All') AS o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def crosstab_margins(spark, sf):
    return P.crosstab_margins(T.table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


STATUS = "SELECT d.doc_id AS id, d.lang, d.source, CASE l.quality WHEN 0 THEN 'lowres' WHEN 1 THEN 'highres_scan' END AS status, d.n_chars > 1000 AS has_faces, l.toxic = 1 AS has_image FROM documents d LEFT JOIN labels l USING (doc_id)"


def statuses(spark, sf):
    labels = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "lowres").when(F.col("quality") == 1, "highres_scan").alias("status"), (F.col("toxic") == 1).alias("has_image"))
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", (F.col("n_chars") > 1000).alias("has_faces"))
    return P.status_lookup(docs, labels.select("id", "status")).join(labels.select("id", "has_image"), "id", "left")


@query("status_lookup", f"SELECT id, status FROM ({STATUS})")
def status_lookup(spark, sf):
    return statuses(spark, sf).select("id", "status")


@query("status_counts", f"SELECT coalesce(status, 'MISSING_FIELD') AS status, count(*) AS n, count(DISTINCT lang) AS languages, count_if(has_faces) AS with_faces, coalesce(count_if(has_image), 0) AS with_image FROM ({STATUS}) GROUP BY 1")
def status_counts(spark, sf):
    return P.status_counts(statuses(spark, sf))


@query("filter_status", f"SELECT id FROM ({STATUS}) WHERE coalesce(status, 'unknown') IN ('lowres', 'unknown')")
def filter_status(spark, sf):
    return P.filter_status(statuses(spark, sf), "lowres", "unknown").select("id")


@query("status_by_our_class", f"SELECT source, status, count(*) AS n FROM ({STATUS}) GROUP BY source, status")
def status_by_our_class(spark, sf):
    return statuses(spark, sf).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("file_size_stats", "SELECT count(p_size) AS present, count_if(p_size IS NULL) AS missing, min(p_size) AS min, max(p_size) AS max, round(avg(p_size), 4) AS mean, median(p_size) AS median FROM orders LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 <> 0) p ON o_orderkey = p_partkey")
def file_size_stats(spark, sf):
    names = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("filename"))
    files = T.table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("filename"), F.col("p_size").alias("length"))
    return P.file_size_stats(names, files)


BREAKDOWN = W + """, c AS (SELECT rarity AS category, {by}, count(*) AS n FROM cat GROUP BY ALL),
t AS (SELECT rarity AS category, count(*) AS total, min(mana_value) AS min_score, max(mana_value) AS max_score, min(pos) AS min_second, max(pos) AS max_second FROM cat GROUP BY rarity)
SELECT c.category, row_number() OVER (PARTITION BY c.category ORDER BY n DESC, {by}) AS place, {by}, n, total, min_score, max_score, min_second, max_second FROM c JOIN t ON c.category IS NOT DISTINCT FROM t.category QUALIFY place <= {most}"""


def _classes(spark, sf):
    return T.catalog(spark, sf).select(F.col("rarity").alias("category"), "set_code", "lang", F.col("mana_value").alias("score"), F.col("pos").alias("second"))


@query("class_breakdown", BREAKDOWN.format(by="set_code", most=10))
def class_breakdown(spark, sf):
    return P.class_breakdown(_classes(spark, sf))


@query("class_languages", BREAKDOWN.format(by="coalesce(lang, '?')", most=1000).replace("c AS (SELECT rarity AS category, coalesce(lang, '?')", "c AS (SELECT rarity AS category, coalesce(lang, '?') AS lang").replace("BY n DESC, coalesce(lang, '?')) AS place, coalesce(lang, '?')", "BY n DESC, lang) AS place, lang"))
def class_languages(spark, sf):
    return P.class_breakdown(_classes(spark, sf), by="lang", most=None)


@query("score_gap", "SELECT round(min(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END) - max(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice END), 4) AS gap FROM part")
def score_gap(spark, sf):
    rows = T.table(spark, sf, "part").select((F.col("p_partkey") % 2 == 0).alias("positive"), F.col("p_retailprice").alias("score"))
    return P.score_gap(rows).select(F.round("gap", 4).alias("gap"))


@query("category_summary", W + " SELECT rarity AS category, count(*) AS images, count(DISTINCT set_code) AS sets, count(DISTINCT name) AS names FROM cat GROUP BY rarity")
def category_summary(spark, sf):
    return P.category_summary(T.catalog(spark, sf).withColumn("category", F.col("rarity")))


@query("distinct_artifacts", W + " SELECT count(DISTINCT name) AS name, count(DISTINCT set_code) AS set_code, count(DISTINCT filename) AS filename FROM cat")
def distinct_artifacts(spark, sf):
    return P.distinct_artifacts(T.catalog(spark, sf), "name", "set_code", "filename")


@query("ocr_rates", W + """ SELECT rarity AS pool, count(*) AS n, 100.0 AS name_pct, round(100.0 * count_if(pos % 2 = 0) / count(*), 4) AS number_pct FROM cat WHERE rarity IS NOT NULL GROUP BY rarity
UNION ALL SELECT NULL, count(*), 100.0, round(100.0 * count_if(pos % 2 = 0) / count(*), 4) FROM cat WHERE rarity IS NOT NULL""")
def ocr_rates(spark, sf):
    """Texts are names in capitals, every other one with a number after it."""
    p = F.col("pos")
    rows = T.catalog(spark, sf).filter("rarity is not null").select(F.col("rarity").alias("pool"), F.concat(F.upper("name"), F.when(p % 2 == 0, " #7").otherwise("")).alias("text"), "name", F.lit("#7").alias("number"))
    return P.ocr_rates(rows)


def _effect(name):
    return f"coalesce(list_contains(frame_effects, '{name}'), false)"


CATEGORIES = FACES + f""", pr AS (SELECT name, count(*) AS printings FROM fc GROUP BY name),
g AS (SELECT fc.*, printings, NOT full_art AND NOT {_effect('showcase')} AND NOT {_effect('extendedart')} AS framed FROM fc JOIN pr USING (name)),
ct AS (
  SELECT *, frame || '_' || border_color AS category FROM g WHERE framed AND layout = 'normal' AND frame IN ('2015', '2003', '1997', '1993', 'future') AND border_color IN ('black', 'white')
  UNION ALL SELECT *, 'border_' || border_color FROM g WHERE framed AND border_color IN ('borderless', 'gold', 'silver', 'yellow')
  UNION ALL SELECT *, 'treatment_fullart_' || border_color FROM g WHERE full_art AND border_color IN ('black', 'borderless')
  UNION ALL SELECT *, 'treatment_showcase' FROM g WHERE {_effect('showcase')} UNION ALL SELECT *, 'treatment_extendedart' FROM g WHERE {_effect('extendedart')}
  UNION ALL SELECT *, 'treatment_etched' FROM g WHERE {_effect('etched')} UNION ALL SELECT *, 'treatment_inverted' FROM g WHERE {_effect('inverted')}
  UNION ALL SELECT *, 'effect_legendary' FROM g WHERE {_effect('legendary')} UNION ALL SELECT *, 'effect_snow' FROM g WHERE {_effect('snow')} UNION ALL SELECT *, 'effect_companion' FROM g WHERE {_effect('companion')}
  UNION ALL SELECT *, 'effect_nyxtouched' FROM g WHERE {_effect('enchantment')} UNION ALL SELECT *, 'effect_colorshifted' FROM g WHERE {_effect('colorshifted')}
  UNION ALL SELECT *, 'layout_' || layout FROM g WHERE layout NOT IN ('normal', 'battle') UNION ALL SELECT *, 'back_face' FROM g WHERE face_index = 1
  UNION ALL SELECT *, 'rarity_' || rarity FROM g WHERE frame = '2015' AND rarity IN ('common', 'uncommon', 'rare', 'mythic', 'special')
  UNION ALL SELECT *, 'multi_printing_5plus' FROM g WHERE printings >= 5 UNION ALL SELECT *, 'multi_printing_20plus' FROM g WHERE printings >= 20)"""


@query("test_categories", CATEGORIES + " SELECT pos, category FROM ct")
def test_categories(spark, sf):
    return S.test_categories(faces(spark, sf)).select("pos", "category")


@query("crop_pools", FACES + f""", b AS (SELECT *, border_color = 'black' AND layout = 'normal' AS plain FROM fc)
SELECT pos, '2015_black' AS pool FROM b WHERE plain AND frame = '2015' AND NOT full_art AND NOT {_effect('showcase')} AND NOT {_effect('extendedart')}
UNION ALL SELECT pos, '2003_black' FROM b WHERE plain AND frame = '2003' UNION ALL SELECT pos, '1997_black' FROM b WHERE plain AND frame = '1997' UNION ALL SELECT pos, '1993_black' FROM b WHERE plain AND frame = '1993'
UNION ALL SELECT pos, 'future' FROM b WHERE frame = 'future' AND layout = 'normal' UNION ALL SELECT pos, 'borderless' FROM b WHERE border_color = 'borderless' AND NOT full_art AND NOT {_effect('showcase')}
UNION ALL SELECT pos, 'borderless_fullart' FROM b WHERE border_color = 'borderless' AND full_art UNION ALL SELECT pos, 'extendedart' FROM b WHERE {_effect('extendedart')}
UNION ALL SELECT pos, 'showcase' FROM b WHERE {_effect('showcase')} UNION ALL SELECT pos, 'white_border' FROM b WHERE border_color = 'white'""")
def crop_pools(spark, sf):
    return S.crop_pools(faces(spark, sf)).select("pos", "pool")


@query("names_in_pool", FACES + " SELECT pos FROM fc WHERE name IN (SELECT name FROM fc GROUP BY name HAVING count(*) >= 5)")
def names_in_pool(spark, sf):
    return S.names_in_pool(faces(spark, sf), 5).select("pos")


def _diverse(pools: str, w: str, n: int, key: str) -> str:
    """The rows of sample_set_diverse of ``pools`` (w, set_code, key), in plain steps."""
    return f""", sh AS (SELECT {w} AS w, sum(c) AS pool, count(*) AS sets FROM (SELECT {w}, set_code, count(*) AS c FROM {pools} GROUP BY ALL) GROUP BY 1),
rk AS (SELECT p.*, sh.*, md5({key} || '|0') AS h, row_number() OVER (PARTITION BY p.{w}, p.set_code ORDER BY md5({key} || '|0'), {key}) AS r FROM {pools} p JOIN sh ON sh.w = p.{w}),
fi AS (SELECT *, pool > {n} AND sets >= 5 AND {n} > 5 AND r <= greatest(1, {n} // (2 * sets)) AS taken FROM rk),
pk AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY w ORDER BY taken DESC, CASE WHEN taken THEN md5(set_code || '|1') END, CASE WHEN taken THEN r END, h, {key}) <= {n})"""


@query("sample_set_diverse", W + ", one AS (SELECT *, 0 AS g FROM cat)" + _diverse("one", "g", 200, "scryfall_id") + " SELECT pos, set_code FROM pk")
def sample_set_diverse(spark, sf):
    return S.sample_set_diverse(T.catalog(spark, sf), 200, "scryfall_id").select("pos", "set_code")


@query("stratified_sample", CATEGORIES + _diverse("ct", "category", 50, "filename") + " SELECT category, pos FROM pk")
def stratified_sample(spark, sf):
    return S.stratified_sample(faces(spark, sf), 50).select("category", "pos")


@query("test_manifest_row", CATEGORIES + """ SELECT filename, category, name, set_code, collector_number, frame, border_color, full_art, layout, coalesce(array_to_string(frame_effects, ','), '') AS frame_effects, rarity, face_index,
  '1.0,2.5;3.2,4.0' AS gt_corners FROM ct""")
def test_manifest_row(spark, sf):
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    return S.test_manifest(S.test_categories(faces(spark, sf)).withColumn("gt_corners", F.array(point(1.0, 2.5), point(3.21, 4.04))))


# The generator's state only grows by a constant, so a draw is an expression over its number here too.
DRAWS = """, d0 AS (SELECT n, (1 + (n + 1) * 1831565813::HUGEINT) & 4294967295 AS s FROM range(5000) r(n)),
d1 AS (SELECT n, (xor(s, s >> 15) * (s | 1)) & 4294967295 AS t FROM d0), d2 AS (SELECT n, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295) AS t FROM d1),
draws AS (SELECT n AS draw, CAST(floor(CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296 * (SELECT count(*) FROM cat)) AS BIGINT) AS pos FROM d2)"""


@query("parity_sample", W + DRAWS + " SELECT draw, draws.pos FROM draws JOIN cat ON cat.pos - 1 = draws.pos WHERE filename IS NOT NULL ORDER BY draw LIMIT 100")
def parity_sample(spark, sf):
    """The hundred rows that seed 1 draws."""
    cat = T.catalog(spark, sf).withColumn("pos", F.col("pos") - 1)
    return S.parity_sample(cat, cat.filter("filename is not null"), 100).select("draw", "pos")
