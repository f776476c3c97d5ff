"""Catalogue: nested records to faces, status, lookups, refresh. Records are made from parts, by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as X
from cardloom.operators import catalog as C
from cardloom.plans import tables as T
from cardloom.plans.registry import query
from cardloom.sources import csv

W = "WITH " + T.CATALOG_SQL


def records(spark, sf):
    """Nested records: parts whose number ends in 1 have two faces and no image of their own, those in 2 no image at all."""
    p = F.col("p_partkey")
    kind = p % 10
    image = lambda name: F.struct(F.concat(F.lit("http://img/"), name).alias("normal"))
    face = lambda i: F.struct(
        F.concat(F.col("p_name"), F.lit(f" {i}")).alias("name"), F.when(F.lit(i == 1), "painter").otherwise("").alias("artist"), F.lit("").alias("mana_cost"),
        F.when(F.lit(i == 1), F.array(F.lit("G"), F.lit("W"))).alias("colors"), F.when(F.lit(i == 0) | (p % 20 == 1), image(F.concat(p.cast("string"), F.lit(f"/{i}")))).alias("image_uris"),
    )
    none = F.lit(None)
    text = lambda v: none.cast("string") if v is None else v
    values = {
        "id": p.cast("string"), "name": F.col("p_name"), "set": F.concat(F.lit("b"), F.regexp_extract("p_brand", "[0-9]+", 0)), "collector_number": F.concat(F.col("p_size").cast("string"), F.when(kind == 3, "★").otherwise("")),
        "layout": F.when(kind == 4, "token").when(kind == 5, text(None)).otherwise("normal"), "type_line": F.when(kind == 6, "Card").otherwise(F.col("p_type")), "frame": F.lit("2015"), "border_color": F.lit("black"),
        "full_art": F.when(kind == 7, True), "frame_effects": F.split("p_name", " "), "colors": F.when(kind == 8, F.array(F.lit("B"), F.lit("U"), F.lit("B"))), "color_identity": F.array(F.lit("R")),
        "rarity": F.lit("rare"), "set_name": F.col("p_brand"), "image_status": F.when(kind == 9, "placeholder").otherwise("highres_scan"), "lang": text(None), "artist": F.lit("someone"),
        "mana_cost": F.lit("{1}"), "cmc": F.when(kind != 0, F.col("p_size").cast("double")), "released_at": text(None), "image_uris": F.when((kind != 1) & (kind != 2), image(p.cast("string"))),
        "card_faces": F.when(kind == 1, F.array(face(0), face(1))).otherwise(none.cast(f"array<{C.FACE}>")),
    }
    return T.table(spark, sf, "part").select(*[v.alias(k) for k, v in values.items()])


RECORDS = """r AS (SELECT *, p_partkey % 10 AS kind, CAST(p_partkey AS VARCHAR) AS id, 'b' || regexp_extract(p_brand, '[0-9]+') AS set_code,
  CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 10 = 3 THEN '★' ELSE '' END AS number FROM part),
faces AS (SELECT r.*, f.i AS face_index FROM r, (VALUES (0), (1)) f(i) WHERE CASE WHEN kind = 2 THEN false WHEN kind = 1 THEN f.i = 0 OR p_partkey % 20 = 1 ELSE f.i = 0 END),
face AS (SELECT id AS scryfall_id, face_index, CASE kind WHEN 1 THEN p_name || ' ' || face_index ELSE p_name END AS name, CASE WHEN kind = 1 AND face_index = 1 THEN 'painter' ELSE 'someone' END AS artist,
  CASE WHEN kind = 8 THEN 'UB' WHEN kind = 1 AND face_index = 1 THEN 'WG' ELSE '' END AS colors, set_code || '-' || replace(number, '★', '_') || CASE WHEN face_index > 0 THEN '_face' || face_index ELSE '' END || '.jpg' AS filename,
  CASE kind WHEN 4 THEN 'token' WHEN 5 THEN '' ELSE 'normal' END AS layout, CASE kind WHEN 6 THEN 'Card' ELSE p_type END AS type_line, CASE kind WHEN 9 THEN 'placeholder' ELSE 'highres_scan' END AS upstream_status, p_partkey, kind, set_code FROM faces)"""


@query("project_card_base", "WITH " + RECORDS + " SELECT id AS scryfall_id, 'en' AS lang, CASE WHEN kind = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS mana_value, kind = 7 AS full_art, '' AS released_at, CASE kind WHEN 5 THEN '' WHEN 4 THEN 'token' ELSE 'normal' END AS layout FROM r")
def project_card_base(spark, sf):
    return C.card_base(records(spark, sf)).select("scryfall_id", "lang", "mana_value", "full_art", "released_at", "layout")


@query("explode_card_faces", "WITH " + RECORDS + " SELECT scryfall_id, face_index, name, artist, colors, filename FROM face")
def explode_card_faces(spark, sf):
    return C.explode_card_faces(records(spark, sf)).select("scryfall_id", "face_index", "name", "artist", "colors", "filename")


@query("color_string", "WITH " + RECORDS + " SELECT id, CASE WHEN kind = 8 THEN 'UB' ELSE '' END AS colors FROM r")
def color_string(spark, sf):
    return records(spark, sf).select("id", X.color_string(F.col("colors")).alias("colors"))


@query("image_filename", "WITH " + RECORDS + " SELECT id, set_code || '-' || replace(number, '★', '_') || '_face2.jpg' AS filename FROM r")
def image_filename(spark, sf):
    return records(spark, sf).select("id", X.image_filename(F.col("set"), F.col("collector_number"), F.lit(2)).alias("filename"))


@query("image_url", "SELECT p_partkey, 'http://img/normal/front/' || substr(i, 1, 1) || '/' || substr(i, 2, 1) || '/' || i || '.jpg' AS url, '/api/cards/' || i || '/image?v=2024-01-02T03%3A04%3A05' AS photo FROM (SELECT p_partkey, CAST(p_partkey + 100 AS VARCHAR) AS i FROM part)")
def image_url(spark, sf):
    i = (F.col("p_partkey") + 100).cast("string")
    return T.table(spark, sf, "part").select("p_partkey", X.image_url("http://img", i).alias("url"), X.photo_url(i, F.lit("2024-01-02T03:04:05")).alias("photo"))


def marked(spark, sf):
    """Faces with their status: files of numbers divisible by 13 are missing, pixels of those by 3 and watermarks of those by 2 hit."""
    faces = C.explode_card_faces(records(spark, sf)).withColumn("n", F.col("scryfall_id").cast("long"))
    faces = faces.withColumn("filename", F.concat("filename", F.lit("?"), "n"))
    disk = faces.filter("n % 13 <> 0").select("filename")
    marks = faces.select("filename", (F.col("n") % 3 == 0).alias("pixel_hit"), (F.col("n") % 2 == 1).alias("watermark_hit"))
    return C.classify_image_status(faces, disk, marks)


STATUS = RECORDS + """, st AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 'missing' WHEN contains(filename, '_face') AND p_partkey % 3 = 0 THEN 'placeholder'
  WHEN upstream_status = 'placeholder' AND p_partkey % 2 = 1 THEN 'placeholder' ELSE 'valid' END AS image_status FROM face)"""


@query("classify_image_status", "WITH " + STATUS + " SELECT scryfall_id, face_index, image_status FROM st")
def classify_image_status(spark, sf):
    return marked(spark, sf).select("scryfall_id", "face_index", "image_status")


@query("filter_playable", "WITH " + STATUS + " SELECT scryfall_id, face_index FROM st WHERE image_status = 'valid' AND layout <> 'token' AND type_line <> 'Card'")
def filter_playable(spark, sf):
    return C.filter_playable(marked(spark, sf)).select("scryfall_id", "face_index")


@query("retry_set", "WITH " + STATUS + " SELECT scryfall_id, face_index FROM st WHERE image_status <> 'valid'")
def retry_set(spark, sf):
    rows = marked(spark, sf)
    return C.retry_set(rows, rows.select("filename", "image_status")).select("scryfall_id", "face_index")


@query("database_summary", "WITH " + STATUS + " SELECT count(*) AS total, count_if(image_status = 'valid') AS valid, count_if(image_status = 'placeholder') AS placeholder, count_if(image_status = 'missing') AS missing, count(DISTINCT set_code) AS sets FROM st")
def database_summary(spark, sf):
    from cardloom.operators.profile import database_summary as summary

    return summary(marked(spark, sf))


@query("placeholder_by_score", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'missing' WHEN a >= 0.1 THEN 'localized' WHEN b >= 0.1 THEN 'commander' ELSE 'real' END AS category FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)")
def placeholder_by_score(spark, sf):
    """Scores are a vector's first two numbers, raised so that 0.1 stands at the limit."""
    v = F.col("vec_id")
    score = lambda i: F.when(v % 7 != 0, F.col("embedding")[i].cast("double") + (C.SCORE - 0.1))
    return C.placeholder_by_score(T.table(spark, sf, "embeddings").select("vec_id", score(0).alias("score_localized"), score(1).alias("score_commander"))).select("vec_id", "category")


@query("placeholder_pixel_diff", """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 9 <> 0 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: 40 * x) END AS p FROM embeddings), r AS (SELECT p AS ref FROM e WHERE vec_id = 1)
SELECT vec_id, CASE WHEN p IS NULL THEN true ELSE list_sum(list_transform(list_zip(p, ref), lambda z: abs(z[1] - z[2]))) / len(p) < 5.0 END AS is_placeholder FROM e, r""")
def placeholder_pixel_diff(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 9 != 0, F.transform("embedding", lambda x: x.cast("double") * 40)).alias("pixels"))
    return C.placeholder_pixel_diff(e, e.filter("vec_id = 1")).select("vec_id", "is_placeholder")


PIXELS = "px AS (SELECT l_orderkey AS image_id, l_linenumber AS x, l_suppkey % 30 AS y, CAST(l_quantity AS INTEGER) AS r, CAST(l_quantity AS INTEGER) + l_linenumber AS g, CAST(l_quantity AS INTEGER) + 3 * l_linenumber AS b FROM lineitem)"


def pixels(spark, sf):
    q = F.col("l_quantity").cast("int")
    return T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("x"), (F.col("l_suppkey") % 30).alias("y"), q.alias("r"), (q + F.col("l_linenumber")).alias("g"), (q + 3 * F.col("l_linenumber")).alias("b"))


@query("placeholder_by_region", "WITH " + PIXELS + """, a AS (SELECT image_id, avg(CASE WHEN greatest(r, g, b) - least(r, g, b) <= 12 THEN 1.0 ELSE 0.0 END) AS grey, coalesce(stddev_pop(CASE WHEN y * 3 < 30 THEN (r + g + b) / 3.0 END), 0) AS top FROM px GROUP BY image_id),
p5 AS (SELECT image_id, 0.299 * (5 * r) + 0.587 * (5 * g) + 0.114 * (5 * b) AS luma FROM px),
t AS (SELECT image_id, avg(CASE WHEN luma > 200 THEN 1.0 ELSE 0.0 END) AS bright, coalesce(avg(CASE WHEN luma <= 200 THEN luma END), avg(luma)) AS rest, avg(CASE WHEN luma < 80 THEN 1.0 ELSE 0.0 END) AS dark, avg(luma) AS mean FROM p5 GROUP BY image_id)
SELECT image_id, CASE WHEN grey > 0.15 THEN 'localized' WHEN top < 15 THEN 'commander' ELSE 'real' END AS category,
  CASE WHEN bright > 0.05 AND rest < 140 THEN 'localized' WHEN dark > 0.15 AND mean > 120 THEN 'commander' ELSE 'real' END AS by_text FROM a JOIN t USING (image_id)""")
def placeholder_by_region(spark, sf):
    """By the second rule, of the same pixels five times as bright."""
    dark = pixels(spark, sf)
    light = dark.withColumns({c: F.col(c) * 5 for c in ("r", "g", "b")})
    by_text = C.placeholder_by_region(light).select("image_id", F.col("category_by_text").alias("by_text"))
    return C.placeholder_by_region(dark).select("image_id", "category").join(by_text, "image_id")


@query("region_stats", "WITH " + PIXELS + """, t AS (SELECT * FROM (VALUES ('top', 0, 0, 9, 15), ('left', 0, 0, 4, 30)) t(name, x0, y0, x1, y1))
SELECT image_id, name, round(avg((r + g + b) / 3.0), 4) AS mean, round(stddev_pop((r + g + b) / 3.0), 4) AS std, max(greatest(r, g, b) - least(r, g, b)) AS spread_max, round(avg(r), 4) AS r_mean
FROM px JOIN t ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY image_id, name""")
def region_stats(spark, sf):
    rectangles = spark.createDataFrame([("top", 0, 0, 9, 15), ("left", 0, 0, 4, 30)], "name string, x0 int, y0 int, x1 int, y1 int")
    rows = C.region_stats(pixels(spark, sf), rectangles)
    return rows.select("image_id", "name", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "spread_max", F.round("r_mean", 4).alias("r_mean"))


@query("find_printings", W + """ SELECT w.pos AS "row", c.scryfall_id, row_number() OVER (PARTITION BY w.pos ORDER BY (coalesce(c.lang, 'en') = 'en') DESC, c.pos) AS place FROM cat w JOIN cat c ON lower(w.set_code) = lower(c.set_code) AND lower(w.collector_number) = lower(c.collector_number)""")
def find_printings(spark, sf):
    cat = T.catalog(spark, sf)
    return C.find_printings(cat.select(F.col("pos").alias("row"), F.upper("set_code").alias("set_code"), "collector_number"), cat).select("row", "scryfall_id", "place")


@query("find_printing", W + """ SELECT "row", scryfall_id FROM (SELECT w.pos AS "row", c.scryfall_id, row_number() OVER (PARTITION BY w.pos ORDER BY coalesce(c.lang = 'ja', false) DESC, (coalesce(c.lang, 'en') = 'en') DESC, c.pos) AS p
  FROM cat w JOIN cat c ON w.set_code = c.set_code AND w.collector_number = c.collector_number) WHERE p = 1""")
def find_printing(spark, sf):
    cat = T.catalog(spark, sf)
    return C.find_printing(cat.select(F.col("pos").alias("row"), "set_code", "collector_number", F.lit("ja").alias("lang")), cat).select("row", "scryfall_id")


@query("new_rows", W + " SELECT pos FROM cat WHERE filename IS NULL OR pos % 3 = 0")
def new_rows(spark, sf):
    cat = T.catalog(spark, sf)
    return C.new_rows(cat, cat.filter("pos % 3 <> 0")).select("pos")


@query("to_download", W + " SELECT pos FROM cat WHERE filename IS NOT NULL AND pos % 5 = 0")
def to_download(spark, sf):
    cat = T.catalog(spark, sf).filter("filename is not null")
    return C.new_rows(cat, cat.filter("pos % 5 <> 0")).select("pos")


@query("refresh_metadata", W + " SELECT pos, filename, CASE WHEN pos % 4 = 0 THEN name ELSE upper(name) END AS name, CASE WHEN pos % 4 = 0 OR lang IS NULL THEN coalesce(lang, 'old') ELSE lang END AS lang, 'kept' AS extra FROM cat WHERE filename IS NOT NULL")
def refresh_metadata(spark, sf):
    """Rows whose number is divisible by 4 have no fresh metadata."""
    cat = T.catalog(spark, sf).filter("filename is not null")
    snapshot = cat.select("pos", "filename", "name", F.coalesce("lang", F.lit("old")).alias("lang"), F.lit("kept").alias("extra"))
    return C.refresh_metadata(snapshot, cat.filter("pos % 4 <> 0").select("pos", "filename", F.upper("name").alias("name"), "lang"))


@query("first_by_filename", W + " SELECT set_code, min(pos) AS pos FROM cat GROUP BY set_code")
def first_by_filename(spark, sf):
    rows = T.catalog(spark, sf).select("pos", F.col("set_code").alias("filename"))
    return C.first_by(rows, "filename").select(F.col("filename").alias("set_code"), "pos")


@query("catalog_first_face", W + " SELECT collector_number AS scryfall_id, min(pos) AS pos FROM cat GROUP BY collector_number")
def catalog_first_face(spark, sf):
    return C.catalog_first_face(T.catalog(spark, sf).select("pos", F.col("collector_number").alias("scryfall_id"))).select("scryfall_id", "pos")


FULL = """, fn AS (SELECT collector_number AS scryfall_id, string_agg(name, ' // ' ORDER BY pos) AS full_name FROM (SELECT collector_number, name, min(pos) AS pos FROM cat GROUP BY collector_number, name) GROUP BY collector_number)"""


def full_names(spark, sf):
    return C.catalog_full_name(T.catalog(spark, sf).select("pos", F.col("collector_number").alias("scryfall_id"), "name"))


@query("catalog_full_name", W + FULL + " SELECT * FROM fn")
def catalog_full_name(spark, sf):
    return full_names(spark, sf)


@query("export_named", W + FULL + " SELECT pos, coalesce(full_name, name) AS name FROM cat LEFT JOIN fn ON fn.scryfall_id = cat.collector_number")
def export_named(spark, sf):
    cards = T.catalog(spark, sf).select("pos", "name", F.col("collector_number").alias("scryfall_id"))
    return csv.named(cards, full_names(spark, sf)).select("pos", "name")


@query("flag_overlap", W + " SELECT pos AS id, CASE WHEN pos % 6 = 0 THEN 'both' WHEN pos % 2 = 0 THEN 'ours' ELSE 'theirs' END AS side FROM cat WHERE pos % 2 = 0 OR pos % 3 = 0")
def flag_overlap(spark, sf):
    ids = T.catalog(spark, sf).select(F.col("pos").alias("id"))
    return C.flag_overlap(ids.filter("id % 2 = 0"), ids.filter("id % 3 = 0"))
