"""Sources and sinks: each writes rows of the driver's tables in its format, and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.plans import tables as T
from cardloom.plans.catalog_queries import RECORDS, records
from cardloom.plans.registry import query
from cardloom.plans.view_queries import CARDS, cards
from cardloom.sources import bulk, csv, files
from cardloom.sources.shared import new_path

W = "WITH " + T.CATALOG_SQL


@query("scan_bulk_cards", "WITH " + RECORDS + " SELECT id, p_name AS name, CASE WHEN kind = 1 THEN 2 ELSE 0 END AS faces FROM r")
def scan_bulk_cards(spark, sf):
    path = new_path(spark, "bulk")
    records(spark, sf).write.json(path, compression="gzip")
    rows = bulk.scan_bulk_cards(spark, path, partitions=8)
    return rows.select("id", "name", F.coalesce(F.nullif(F.size("card_faces"), F.lit(-1)), F.lit(0)).alias("faces"))


@query("scan_latest_bulk", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0")
def scan_latest_bulk(spark, sf):
    path = new_path(spark, "dated")
    records(spark, sf).write.json(f"{path}/bulk-20240101")
    records(spark, sf).filter("cast(id as long) % 2 = 0").write.json(f"{path}/bulk-20240202")
    return bulk.scan_latest_bulk(spark, path).select("id", "name")


@query("scan_card_metadata", W + " SELECT scryfall_id, name, CASE WHEN pos % 2 = 0 THEN artist END AS artist, CASE WHEN pos % 3 <> 0 THEN mana_value END AS mana_value, CAST(NULL AS VARCHAR) AS released_at FROM cat")
def scan_card_metadata(spark, sf):
    path = new_path(spark, "metadata")
    p = F.col("pos")
    cat = T.catalog(spark, sf).withColumns({"artist": F.when(p % 2 == 0, F.col("artist")).otherwise(""), "cmc": F.when(p % 3 != 0, F.col("mana_value")).otherwise(F.lit(float("nan")))})
    cat.withColumnsRenamed({"scryfall_id": "id", "set_code": "set"}).drop("mana_value", "released_at").write.parquet(path)
    return bulk.scan_card_metadata(spark, path).select("scryfall_id", "name", "artist", "mana_value", "released_at")


@query("write_card_database", W + " SELECT scryfall_id, name, set_code, collector_number FROM cat")
def write_card_database(spark, sf):
    path = new_path(spark, "database")
    bulk.write_card_database(T.catalog(spark, sf), path)
    return spark.read.parquet(path).select("scryfall_id", "name", "set_code", "collector_number")


@query("index_snapshot_io", "SELECT vec_id AS pos, len(embedding) AS dim, CAST(label AS VARCHAR) AS name FROM embeddings")
def index_snapshot_io(spark, sf):
    path = new_path(spark, "snapshot")
    bulk.save_snapshot(T.index(spark, sf), path)
    return bulk.load_snapshot(spark, path, 64).select("pos", F.size("embedding").alias("dim"), "name")


@query("scan_flat_vector_file", "SELECT vec_id AS pos, round(CAST(embedding[1] AS DOUBLE), 4) AS first, round(CAST(embedding[64] AS DOUBLE), 4) AS last FROM embeddings")
def scan_flat_vector_file(spark, sf):
    path = new_path(spark, "flat")
    files.write_flat_vectors(T.index(spark, sf), path, 64)
    part = lambda i: F.round(F.col("embedding")[i].cast("double"), 4)
    return files.scan_flat_vector_file(spark, path).select("pos", part(0).alias("first"), part(63).alias("last"))


@query("scan_csv_rfc4180", "SELECT doc_id, length(text) AS n, source FROM documents")
def scan_csv_rfc4180(spark, sf):
    path = new_path(spark, "csv")
    T.table(spark, sf, "documents").select("doc_id", "text", "source").write.csv(path, header=True, quote='"', escape='"')
    rows = csv.scan_csv(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n"), "source")


@query("scan_moxfield_csv", CARDS + " SELECT count(*) AS n, CAST(sum(count) AS BIGINT) AS copies, count_if(foil) AS foils, count(updated_at) AS dated, 0 AS errors FROM cards")
def scan_moxfield_csv(spark, sf):
    path = new_path(spark, "collection")
    csv.export_moxfield_csv(cards(spark, sf), path)
    rows = csv.scan_moxfield_csv(spark, path)
    return rows.agg(F.count("*").alias("n"), F.sum("count").alias("copies"), F.count_if(F.col("foil")).alias("foils"), F.count("modified_at").alias("dated"), F.count("error").alias("errors"))


@query("export_moxfield_csv", CARDS + """ SELECT CAST(count AS VARCHAR) AS "Count", name AS "Name", set_code AS "Edition", CASE WHEN foil THEN 'foil' ELSE '' END AS "Foil", strftime(updated_at, '%Y-%m-%d %H:%M:%S.%g') || '000' AS "Last Modified", 'Near Mint' AS "Condition" FROM cards""")
def export_moxfield_csv(spark, sf):
    path = new_path(spark, "collection")
    csv.export_moxfield_csv(cards(spark, sf), path)
    rows = csv.scan_csv(spark, path)
    return rows.select("Count", "Name", "Edition", F.coalesce("Foil", F.lit("")).alias("Foil"), "Last Modified", "Condition")


@query("export_full_csv", CARDS + " SELECT card_id, coalesce(scryfall_id, '') AS scryfall_id, CAST(count AS VARCHAR) AS count, CASE WHEN foil THEN 'true' ELSE 'false' END AS foil, coalesce(rarity, '') AS rarity FROM cards")
def export_full_csv(spark, sf):
    path = new_path(spark, "full")
    csv.export_full_csv(cards(spark, sf), path)
    rows = csv.scan_csv(spark, path)
    return rows.select("card_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("scryfall_id", "count", "foil", "rarity")])


@query("filter_exportable", CARDS + " SELECT card_id FROM cards WHERE scryfall_id IS NOT NULL OR foil")
def filter_exportable(spark, sf):
    rows = cards(spark, sf).withColumn("name", F.when(F.col("scryfall_id").isNull() & ~F.col("foil"), "Unknown").otherwise(F.col("name")))
    return csv.exportable(rows).select("card_id")


@query("scan_file_manifest", "SELECT DISTINCT o_orderpriority || '.jpg' AS filename FROM orders".replace("o_orderpriority", "regexp_replace(o_orderpriority, '[^A-Z0-9]', '', 'g')"))
def scan_file_manifest(spark, sf):
    """A file per priority: Spark's files of each are named by their folder."""
    path = new_path(spark, "photos")
    kind = F.regexp_replace("o_orderpriority", "[^A-Z0-9]", "")
    T.table(spark, sf, "orders").select(kind.alias("kind"), F.col("o_orderkey").cast("string").alias("value")).repartition("kind").write.partitionBy("kind").text(path)
    found = files.scan_file_manifest(spark, path, "*.txt")
    folder = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.regexp_extract("path", "kind=([^/]*)", 1).alias("kind"))
    return found.join(folder, "filename").select(F.concat("kind", F.lit(".jpg")).alias("filename")).distinct()


@query("scan_manifest_csv", W + " SELECT 'f' || pos AS filename, pos % 7 = 0 AS full_art, 0 AS face_index, 'a,b' AS frame_effects FROM cat")
def scan_manifest_csv(spark, sf):
    path = new_path(spark, "manifest")
    p = F.col("pos")
    given = {"filename": F.concat(F.lit("f"), p), "full_art": p % 7 == 0, "face_index": F.lit(0), "frame_effects": F.lit("a,b"), "name": F.col("name"), "set_code": F.col("set_code")}
    names = [x.split()[0] for x in csv.MANIFEST.split(", ")]
    T.catalog(spark, sf).select(*[given.get(n, F.lit("x")).alias(n) for n in names]).write.csv(path, header=True, quote='"', escape='"')
    return csv.scan_manifest_csv(spark, path).select("filename", "full_art", "face_index", "frame_effects")


@query("write_results_csv", "WITH " + T.RESULTS_SQL + " SELECT mode, count(*) AS n, count_if(top1_name) AS names FROM res GROUP BY mode")
def write_results_csv(spark, sf):
    path = new_path(spark, "results")
    csv.write_results_csv(T.results(spark, sf), path)
    rows = spark.read.csv(path, header=True)
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.count_if(F.col("top1_name") == "true").alias("names"))


@query("scan_ground_truth_json", W + " SELECT 'p' || pos AS path, name, CASE WHEN pos % 2 = 0 THEN set_code END AS set_code, CASE WHEN pos % 2 = 0 THEN collector_number END AS collector_number FROM cat")
def scan_ground_truth_json(spark, sf):
    """Objects of some hundred paths each: names, or objects, by path."""
    path = new_path(spark, "truth")
    p = F.col("pos")
    text = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    struct = F.concat(F.lit('{"card_name":'), text("name"), F.lit(',"set_code":'), text("set_code"), F.lit(',"collector_number":'), text("collector_number"), F.lit("}"))
    pair = F.concat(F.lit('"p'), p, F.lit('":'), F.when(p % 2 == 0, struct).otherwise(text("name")))
    group = F.floor(p / 512).alias("g")
    objects = T.catalog(spark, sf).groupBy(group).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ","), F.lit("}")).alias("value"))
    objects.select("value", "g").write.partitionBy("g").text(path)
    return files.scan_ground_truth_json(spark, path + "/*")


@query("scan_obb_labels", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def scan_obb_labels(spark, sf):
    path = new_path(spark, "labels")
    lines = T.table(spark, sf, "lineitem").select(F.concat("l_orderkey", F.lit(" 0 0 1 0 1 1 0 1\n ")).alias("value"))
    lines.write.text(path)
    rows = files.scan_obb_labels(spark, path)
    return rows.groupBy(F.element_at(F.split("value", " "), 1).cast("long").alias("l_orderkey")).agg(F.count("*").alias("n"))


