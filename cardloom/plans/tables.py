"""The driver's tables as a catalogue, a collection, vectors and detections, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG_SQL = """cat AS (
  SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS scryfall_id, p_name AS name, 'b' || regexp_extract(p_brand, '[0-9]+') AS set_code,
    CAST(p_size AS VARCHAR) AS collector_number, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 2 THEN 'ja' END AS lang, p_type AS type_line,
    CAST(p_size % 9 AS DOUBLE) AS mana_value, CASE p_partkey % 5 WHEN 0 THEN 'mythic' WHEN 1 THEN 'rare' WHEN 2 THEN 'uncommon' WHEN 3 THEN 'common' END AS rarity,
    'artist ' || (p_partkey % 7) AS artist, 'Brand ' || regexp_extract(p_brand, '[0-9]+') AS set_name,
    CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'W' WHEN 2 THEN 'UB' END AS colors, CAST(2000 + p_size AS VARCHAR) || '-01-01' AS released_at,
    CASE WHEN p_partkey % 11 <> 0 THEN 'f' || p_partkey || '.jpg' END AS filename
  FROM part)"""
LIBRARY_SQL = """lib AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS card_id, CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS scryfall_id,
    'part ' || l_partkey AS name, 'b' || (l_partkey % 25) AS set_code, CAST(l_suppkey AS VARCHAR) AS collector_number, l_returnflag = 'R' AS foil, CAST(l_quantity AS BIGINT) AS count,
    l_shipdate AS created_at, l_shipdate AS updated_at, ((l_orderkey * 1000000 + l_partkey) * 1000 + l_suppkey) * 10 + l_linenumber AS ord,
    CASE WHEN l_linenumber = 1 THEN 'photo ' || l_orderkey END AS photo
  FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate)),
held0 AS (SELECT * FROM lib WHERE created_at < TIMESTAMP '1998-01-01'), batch AS (SELECT * FROM lib WHERE created_at >= TIMESTAMP '1998-01-01'),
aged AS (SELECT *, CAST(epoch_us(created_at) AS HUGEINT) * 1000000000000000000 + ord AS age FROM held0 WHERE scryfall_id IS NOT NULL),
held AS (
  SELECT arg_min(card_id, age) AS card_id, scryfall_id, arg_min(name, age) AS name, arg_min(set_code, age) AS set_code, arg_min(collector_number, age) AS collector_number, foil, CAST(sum(count) AS BIGINT) AS count,
    max(created_at) AS created_at, arg_min(updated_at, age) AS updated_at, arg_min(ord, age) AS ord,
    coalesce(nullif(arg_min(coalesce(photo, ''), age), ''), arg_max(photo, age) FILTER (photo IS NOT NULL)) AS photo FROM aged GROUP BY scryfall_id, foil
  UNION ALL SELECT card_id, scryfall_id, name, set_code, collector_number, foil, count, created_at, updated_at, ord, photo FROM held0 WHERE scryfall_id IS NULL)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    number = F.regexp_extract("p_brand", "[0-9]+", 0)
    return table(spark, sf_dir, "part").select(
        p.alias("pos"), p.cast("string").alias("scryfall_id"), F.col("p_name").alias("name"), F.concat(F.lit("b"), number).alias("set_code"),
        F.col("p_size").cast("string").alias("collector_number"), F.when(p % 3 == 0, "en").when(p % 3 == 2, "ja").alias("lang"), F.col("p_type").alias("type_line"),
        (F.col("p_size") % 9).cast("double").alias("mana_value"), F.when(p % 5 == 0, "mythic").when(p % 5 == 1, "rare").when(p % 5 == 2, "uncommon").when(p % 5 == 3, "common").alias("rarity"),
        F.concat(F.lit("artist "), p % 7).alias("artist"), F.concat(F.lit("Brand "), number).alias("set_name"), F.when(p % 4 == 0, "").when(p % 4 == 1, "W").when(p % 4 == 2, "UB").alias("colors"),
        F.concat((F.col("p_size") + 2000).cast("string"), F.lit("-01-01")).alias("released_at"), F.when(p % 11 != 0, F.concat(F.lit("f"), p, F.lit(".jpg"))).alias("filename"),
    )


def library_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by part, of which printings are made: the first of a key is taken where they lie, and a fold by
    printing is done before its own shuffle."""
    key = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    order = ("l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    rows = table(spark, sf_dir, "lineitem").select(*key, *order).repartition("l_partkey").withColumn("place", place).filter("place = 1")
    part = F.col("l_partkey")
    return rows.select(
        F.concat_ws("-", *key).alias("card_id"), F.when(part % 17 != 0, part.cast("string")).alias("scryfall_id"), F.concat(F.lit("part "), part).alias("name"),
        F.concat(F.lit("b"), part % 25).alias("set_code"), F.col("l_suppkey").cast("string").alias("collector_number"), (F.col("l_returnflag") == "R").alias("foil"),
        F.col("l_quantity").cast("long").alias("count"), F.col("l_shipdate").alias("created_at"), F.col("l_shipdate").alias("updated_at"),
        (((F.col("l_orderkey") * 1000000 + part) * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("photo "), F.col("l_orderkey"))).alias("photo"),
    )


def held_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A folded collection of what came before 1998, and the rows after."""
    from cardloom.operators.library import fold_duplicates

    rows = library_rows(spark, sf_dir)
    first = F.lit("1998-01-01").cast("timestamp")
    return fold_duplicates(rows.filter(F.col("created_at") < first)), rows.filter(F.col("created_at") >= first)


VECTORS_SQL = """
q0 AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS VARCHAR) AS gt_name, vec_id AS gt_pos FROM embeddings WHERE vec_id % 50 = 0),
half AS (SELECT query_id, gt_name, gt_pos, list_transform(e, lambda x, i: CASE WHEN i <= 32 THEN 0.0 ELSE x END) AS h FROM q0),
q AS (SELECT 'base' AS mode, query_id, gt_name, gt_pos, e FROM q0 UNION ALL
  SELECT 'half', query_id, gt_name, gt_pos, list_transform(h, lambda x: x / sqrt(list_inner_product(h, h))) FROM half),
scored AS (SELECT mode, query_id, gt_name, gt_pos, vec_id AS pos, CAST(label AS VARCHAR) AS name, round(list_inner_product(e, CAST(embedding AS DOUBLE[])), 12) AS score FROM q, embeddings),
hits AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, pos) AS rank FROM scored QUALIFY rank <= 20)"""


CUT = {"half": 32, "tail": 60}


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", F.col("label").cast("string").alias("name"))


def queries(spark: SparkSession, sf_dir: str, mode: str = "base") -> DataFrame:
    """Every vector whose id is divisible by 50; mode half: without its first half, of norm one again; mode tail: without
    all but its last four numbers."""
    from cardloom.functions.vectors import norm

    rows = index(spark, sf_dir).filter("pos % 50 = 0").select(F.col("pos").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("name").alias("gt_name"), F.col("pos").alias("gt_pos"))
    if mode == "base":
        return rows
    cut = rows.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < CUT[mode], F.lit(0.0)).otherwise(x)))
    return cut.withColumn("_n", norm("embedding")).withColumn("embedding", F.transform("embedding", lambda x: x / F.col("_n"))).drop("_n")


def hits(spark: SparkSession, sf_dir: str, mode: str = "base", k: int = 20) -> DataFrame:
    """query_id, rank, pos, score, name."""
    from cardloom.operators.vectors import topk, with_metadata

    found = topk(queries(spark, sf_dir, mode), index(spark, sf_dir), k)
    return with_metadata(found, index(spark, sf_dir).select("pos", "name"))


def results(spark: SparkSession, sf_dir: str, other: str = "half") -> DataFrame:
    """Evaluation rows of the base mode and another, with stand-ins for what describes a card."""
    from cardloom.operators.evaluate import layer1

    def of(mode: str) -> DataFrame:
        return layer1(queries(spark, sf_dir, mode).drop("embedding"), hits(spark, sf_dir, mode)).withColumn("mode", F.lit(mode))

    q = F.col("query_id")
    return of("base").unionByName(of(other)).select(
        "*", F.lit(True).alias("detected"), F.concat(F.lit("frame "), q % 3).alias("frame"), F.when(q % 4 != 0, F.concat(F.lit("border "), q % 4)).alias("border_color"),
        F.lit("normal").alias("layout"), F.concat(F.lit("rarity "), F.col("gt_name")).alias("rarity"), F.lit("").alias("category"), (q / 50 % 2).cast("int").alias("face_index"),
    )


RESULTS_SQL = VECTORS_SQL + """,
top AS (SELECT mode, query_id, name AS top_name, score AS top_score, pos AS top_pos FROM hits WHERE rank = 1),
res AS (
  SELECT h.mode, h.query_id, any_value(h.gt_name) AS gt_name, any_value(h.gt_pos) AS gt_pos, any_value(top_pos) = any_value(h.gt_pos) AS top1_exact, any_value(top_name) = any_value(h.gt_name) AS top1_name,
    any_value(top_score) AS top1_sim, any_value(top_name) AS top1_pred_name, any_value(top_pos) AS top1_pred_pos,
    coalesce(max(score) - max(CASE WHEN name <> top_name THEN score END), 1.0) AS name_gap,
    coalesce(min(CASE WHEN pos = h.gt_pos THEN rank END), -1) AS exact_rank, coalesce(min(CASE WHEN name = h.gt_name THEN rank END), -1) AS name_rank,
    true AS detected, 'frame ' || (h.query_id % 3) AS frame, CASE WHEN h.query_id % 4 <> 0 THEN 'border ' || (h.query_id % 4) END AS border_color, 'normal' AS layout,
    'rarity ' || any_value(h.gt_name) AS rarity, '' AS category, CAST((h.query_id // 50) % 2 AS INTEGER) AS face_index
  FROM hits h JOIN top USING (mode, query_id) GROUP BY h.mode, h.query_id)"""
TAIL_SQL = RESULTS_SQL.replace("i <= 32", "i <= 60").replace("'half'", "'tail'")
