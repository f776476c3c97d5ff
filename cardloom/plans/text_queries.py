"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import text as X
from cardloom.plans import tables as T
from cardloom.plans.registry import query

W = "WITH " + T.CATALOG_SQL


@query("search_rank", W + " SELECT pos, CASE WHEN name = 'small ring' THEN 0 WHEN starts_with(name, 'small') THEN 1 ELSE -1 END AS a, CASE WHEN name = 'ring' THEN 0 WHEN starts_with(name, 'ring') THEN 1 WHEN contains(name, ' ring') THEN 2 WHEN contains(name, 'ring') THEN 3 ELSE -1 END AS b FROM cat".replace("CASE WHEN name = 'small ring' THEN 0 WHEN starts_with(name, 'small') THEN 1 ELSE -1 END", "CASE WHEN name = 'small' THEN 0 WHEN starts_with(name, 'small') THEN 1 WHEN contains(name, ' small') THEN 2 WHEN contains(name, 'small') THEN 3 ELSE -1 END"))
def search_rank(spark, sf):
    name = F.col("name")
    return T.catalog(spark, sf).select("pos", X.search_rank(name, F.lit("small")).alias("a"), X.search_rank(name, F.lit("ring")).alias("b"))


@query("parse_set_number", W + " SELECT pos, set_code AS code, collector_number AS number, set_code AS code2, collector_number || '★' AS number2, true AS none FROM cat")
def parse_set_number(spark, sf):
    one, two = X.parse_set_number(F.concat(F.upper("set_code"), F.lit(" #"), "collector_number")), X.parse_set_number(F.concat("set_code", F.lit("-"), "collector_number", F.lit("★")))
    return T.catalog(spark, sf).select("pos", one["code"].alias("code"), one["number"].alias("number"), two["code"].alias("code2"), two["number"].alias("number2"), X.parse_set_number(F.col("collector_number")).isNull().alias("none"))


@query("parse_library_set_number", W + " SELECT pos, set_code AS code, collector_number || '/x' AS number FROM cat")
def parse_library_set_number(spark, sf):
    hit = X.parse_set_number(F.concat("set_code", F.lit(":"), "collector_number", F.lit("/x")), X.LOOSE_SET_NUMBER)
    return T.catalog(spark, sf).select("pos", hit["code"].alias("code"), hit["number"].alias("number"))


@query("number_key", W + " SELECT pos, lower(set_code) || '|' || lower(collector_number) AS key FROM cat")
def number_key(spark, sf):
    return T.catalog(spark, sf).select("pos", X.number_key(F.upper("set_code"), F.col("collector_number")).alias("key"))


@query("mana_bucket", "SELECT p_partkey, CASE WHEN v >= 6 THEN '6+' ELSE CAST(CAST(floor(v) AS BIGINT) AS VARCHAR) END AS bucket FROM (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_size / 5.0 END AS v FROM part)")
def mana_bucket(spark, sf):
    value = F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 5.0)
    return T.table(spark, sf, "part").select("p_partkey", X.mana_bucket(value).alias("bucket"))


@query("language_code", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' ELSE 'en' END AS code FROM documents")
def language_code(spark, sf):
    name = F.when(F.col("lang") == "fr", "French").when(F.col("lang") == "de", " german ").when(F.col("lang") == "es", "SPANISH").otherwise("Klingon")
    return T.table(spark, sf, "documents").select("doc_id", X.language_code(name).alias("code"))


@query("parse_moxfield_ts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) END AS at FROM events")
def parse_moxfield_ts(spark, sf):
    e, whole = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.when(e == 0, F.replace(whole, F.lit(" "), F.lit("T"))).when(e == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).when(e == 2, "yesterday").otherwise("2020-13-45 99:00:00")
    return T.table(spark, sf, "events").select("event_id", X.parse_timestamp(text).alias("at"))


@query("format_moxfield_ts", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || '000' AS text FROM events")
def format_moxfield_ts(spark, sf):
    return T.table(spark, sf, "events").select("event_id", X.format_timestamp(F.col("ts")).alias("text"))


@query("csv_field", """SELECT event_id, '"' || replace(props, '"', '""') || '"' AS field, event_type AS plain FROM events""")
def csv_field(spark, sf):
    return T.table(spark, sf, "events").select("event_id", X.csv_field(F.col("props")).alias("field"), X.csv_field(F.col("event_type")).alias("plain"))


@query("placeholder_key", W + " SELECT pos, lower(name) || '|' || set_code || '|' || coalesce(lang, '') || '|true' AS key FROM cat")
def placeholder_key(spark, sf):
    return T.catalog(spark, sf).select("pos", X.placeholder_key(F.upper("name"), F.col("set_code"), F.col("lang"), F.lit(True)).alias("key"))


@query("normalize_name", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' ') AS name FROM documents")
def normalize_name(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.normalize_name(F.col("text")).alias("name"))


@query("sanitize", "SELECT page_id, left(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9_\\s-]', '', 'g'), '\\s+', '_', 'g'), 30) AS name FROM pages")
def sanitize(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", X.sanitize(F.col("url"), 30).alias("name"))


@query("parse_corners", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 0.5 AS x, CAST(l_linenumber AS DOUBLE) AS y, true AS bad FROM lineitem")
def parse_corners(spark, sf):
    text = F.concat(F.col("l_quantity") + 0.5, F.lit(","), "l_linenumber", F.lit(";1,2"))
    rows = T.table(spark, sf, "lineitem").withColumn("c", X.parse_corners(text)).withColumn("bad", X.parse_corners(F.concat(text, F.lit(";x,1"))).isNull())
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("c")[0]["x"].alias("x"), F.col("c")[0]["y"].alias("y"), "bad")


@query("format_corners", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.1f,%.1f', l_quantity, l_linenumber + 0.25) AS text FROM lineitem".replace("l_linenumber + 0.25", "CAST(l_linenumber AS DOUBLE)"))
def format_corners(spark, sf):
    points = F.array(F.struct(F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y")))
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.format_corners(points).alias("text"))


@query("capitalize", W + " SELECT pos, upper(substr(name, 1, 1)) || substr(name, 2) AS name FROM cat")
def capitalize(spark, sf):
    return T.catalog(spark, sf).select("pos", X.capitalize(F.col("name")).alias("name"))


@query("fuzzy_ratio", W + """ SELECT pos, round(2.0 * length(name) / (2 * length(name) + 2), 4) AS longer, round(2.0 * (length(name) // 2) / (length(name) + length(name) // 2), 4) AS half,
  round(2.0 * length(name) / (3 * length(name) + 1), 4) AS twice, CAST(0 AS DOUBLE) AS other FROM cat""")
def fuzzy_ratio(spark, sf):
    """Pairs whose ratio is known: the name with more after it, its first half, it twice with something between, and none of
    its letters. Tests compare other pairs with a plain version."""
    name = F.col("name")
    pairs = {"longer": F.concat(name, F.lit("##")), "half": F.substr(name, F.lit(1), F.floor(F.length(name) / 2).cast("int")), "twice": F.concat(name, F.lit("#"), name), "other": F.lit("####")}
    return T.catalog(spark, sf).select("pos", *[F.round(X.fuzzy_ratio(name, other), 4).alias(k) for k, other in pairs.items()])
