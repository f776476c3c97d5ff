"""Detection tables: boxes made from line items, an order being an image."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardloom.operators import detections as D
from cardloom.plans import tables as T
from cardloom.plans.registry import query

# One detection per (order, part, supplier, line).
BOXES = """b AS (SELECT l_orderkey AS image_id, (l_partkey * 1000 + l_suppkey) * 10 + l_linenumber AS det_id, CAST(l_partkey % 200 AS DOUBLE) AS cx, CAST(l_suppkey % 200 AS DOUBLE) AS cy, 20 + l_quantity AS w,
  30.0 + l_linenumber AS h, (l_partkey % 7) / 2.0 AS angle, 1 - l_discount * 7 AS conf FROM (SELECT DISTINCT ON (l_orderkey, l_partkey, l_suppkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount))"""
W = "WITH " + BOXES


def boxes(spark, sf):
    """Lines are dealt by image, which is how boxes meet each other, and the first of a key is taken where they lie."""
    key = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("l_quantity", "l_discount"))
    rows = T.table(spark, sf, "lineitem").select(*key, "l_quantity", "l_discount").repartition("l_orderkey").withColumn("place", place).filter("place = 1")
    p = F.col("l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("image_id"), ((p * 1000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("det_id"), (p % 200).cast("double").alias("cx"), (F.col("l_suppkey") % 200).cast("double").alias("cy"),
        (F.col("l_quantity") + 20).alias("w"), (F.col("l_linenumber") + 30).cast("double").alias("h"), ((p % 7) / 2.0).alias("angle"), (1 - F.col("l_discount") * 7).alias("conf"),
    )


@query("decode_detections", "SELECT vec_id AS image_id, layout, d AS det_id, round(CASE layout WHEN 0 THEN embedding[d * 7 + 1] ELSE embedding[d + 1] END, 4) AS cx, round(CASE layout WHEN 0 THEN embedding[d * 7 + 5] ELSE embedding[4 * 9 + d + 1] END, 4) AS conf, round(CASE layout WHEN 0 THEN embedding[d * 7 + 7] ELSE embedding[5 * 9 + d + 1] END, 4) AS angle FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings), (VALUES (0), (1)) l(layout), range(9) r(d)")
def decode_detections(spark, sf):
    """Each vector's first numbers as nine detections in either layout."""
    rows = T.table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("layout"))
    dims = F.when(F.col("layout") == 0, F.array(F.lit(1), F.lit(9), F.lit(7))).otherwise(F.array(F.lit(1), F.lit(6), F.lit(9)))
    raw = rows.select((F.col("vec_id") * 2 + F.col("layout")).alias("image_id"), dims.alias("dims"), F.col("embedding").alias("data"))
    out = D.decode_detections(raw)
    return out.select(F.floor(F.col("image_id") / 2).alias("image_id"), (F.col("image_id") % 2).cast("int").alias("layout"), "det_id", *[F.round(c, 4).alias(c) for c in ("cx", "conf", "angle")])


@query("filter_detections", W + " SELECT image_id, det_id FROM b WHERE conf >= 0.35 AND w > 1 AND h > 1 AND det_id % 5 <> 0 AND cx BETWEEN 0 AND 150 AND cy BETWEEN 0 AND 150")
def filter_detections(spark, sf):
    """Every fifth box has a confidence that isn't a number."""
    rows = boxes(spark, sf).withColumn("conf", F.when(F.col("det_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("conf")))
    return D.filter_detections(rows, size=150.0).select("image_id", "det_id")


IOU = W + """, e AS (SELECT *, (w * abs(cos(angle)) + h * abs(sin(angle))) / 2 AS hw, (w * abs(sin(angle)) + h * abs(cos(angle))) / 2 AS hh FROM b),
i AS (SELECT x.image_id, x.det_id AS a, y.det_id AS b, greatest(least(x.cx + x.hw, y.cx + y.hw) - greatest(x.cx - x.hw, y.cx - y.hw), 0) * greatest(least(x.cy + x.hh, y.cy + y.hh) - greatest(x.cy - x.hh, y.cy - y.hh), 0) AS common,
  4 * x.hw * x.hh + 4 * y.hw * y.hh AS area FROM e x JOIN e y ON x.image_id = y.image_id AND x.det_id < y.det_id)"""


@query("pairwise_iou", IOU + " SELECT image_id, a, b, round(common / (area - common), 4) AS iou FROM i WHERE common > 0")
def pairwise_iou(spark, sf):
    return D.pairwise_iou(boxes(spark, sf)).select("image_id", "a", "b", F.round("iou", 4).alias("iou"))


@query("nms", IOU.replace("WITH ", "WITH RECURSIVE ", 1) + """, ranked AS (SELECT image_id, det_id, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS r FROM b),
clash AS (SELECT image_id, a, b FROM i WHERE common / (area - common) > 0.5),
near AS (SELECT x.image_id, x.det_id, list(y.det_id) AS foes FROM ranked x JOIN clash c ON c.image_id = x.image_id AND (c.a = x.det_id OR c.b = x.det_id) JOIN ranked y ON y.image_id = x.image_id AND y.det_id = CASE WHEN c.a = x.det_id THEN c.b ELSE c.a END AND y.r < x.r GROUP BY ALL),
k AS (SELECT image_id, 0 AS r, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT image_id FROM b)
  UNION ALL SELECT k.image_id, k.r + 1, CASE WHEN n.foes IS NOT NULL AND list_has_any(n.foes, k.kept) THEN k.kept ELSE list_append(k.kept, x.det_id) END
  FROM k JOIN ranked x ON x.image_id = k.image_id AND x.r = k.r + 1 LEFT JOIN near n ON n.image_id = x.image_id AND n.det_id = x.det_id),
l AS (SELECT image_id, arg_max(kept, r) AS kept FROM k GROUP BY image_id) SELECT image_id, unnest(kept) AS det_id FROM l""")
def nms(spark, sf):
    return D.nms(boxes(spark, sf)).select("image_id", "det_id")


@query("normalize_portrait", W + " SELECT image_id, det_id, least(w, h) AS w, greatest(w, h) AS h, round(t - pi() * ceil((t - pi() / 2) / pi()), 4) AS angle FROM (SELECT *, CASE WHEN w > h THEN angle + pi() / 2 ELSE angle END AS t FROM b)")
def normalize_portrait(spark, sf):
    return D.normalize_portrait(boxes(spark, sf)).select("image_id", "det_id", "w", "h", F.round("angle", 4).alias("angle"))


CORNER = "round(cx + ({a} * w / 2) * cos(angle) - ({b} * h / 2) * sin(angle), 4) AS x{i}, round(cy + ({a} * w / 2) * sin(angle) + ({b} * h / 2) * cos(angle), 4) AS y{i}"


@query("box_corners", W + " SELECT image_id, det_id, " + ", ".join(CORNER.format(a=a, b=b, i=i) for i, (a, b) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))) + " FROM b")
def box_corners(spark, sf):
    c = F.col("corners")
    parts = [F.round(c[i][axis], 4).alias(f"{axis}{i}") for i in range(4) for axis in ("x", "y")]
    return D.box_corners(boxes(spark, sf)).select("image_id", "det_id", *parts)


@query("order_corners", W + " SELECT image_id, det_id, cx AS tl_x, cy AS tl_y, cx + w AS br_x, cy + h AS br_y, cx + w AS tr_x, cy AS tr_y, cx AS bl_x FROM b")
def order_corners(spark, sf):
    """Upright boxes with their corners shuffled."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    o = D.order_corners(F.array(point(x, y + h), point(x + w, y), point(x + w, y + h), point(x, y)))
    rows = boxes(spark, sf).withColumn("o", o)
    at = lambda i, axis, name: F.col("o")[i][axis].alias(name)
    return rows.select("image_id", "det_id", at(0, "x", "tl_x"), at(0, "y", "tl_y"), at(2, "x", "br_x"), at(2, "y", "br_y"), at(1, "x", "tr_x"), at(1, "y", "tr_y"), at(3, "x", "bl_x"))


@query("corner_errors", W + " SELECT image_id, det_id, 5.0 AS mean_error, 5.0 AS max_error, 4 AS n FROM b")
def corner_errors(spark, sf):
    """Detected corners lie three to the right and four below the true ones."""
    rows = D.box_corners(boxes(spark, sf)).withColumnRenamed("corners", "gt")
    rows = rows.withColumn("detected", F.transform("gt", lambda p: F.struct((p["x"] + 3).alias("x"), (p["y"] + 4).alias("y"))))
    return D.corner_errors(rows).select("image_id", "det_id", F.round("mean_error", 4).alias("mean_error"), F.round("max_error", 4).alias("max_error"), F.size("inside").alias("n"))


LINE = "concat_ws(' ', CAST(det_id % 3 AS VARCHAR), printf('%.6f', cx / 400), printf('%.6f', cy / 400), printf('%.6f', (cx + w) / 400), printf('%.6f', cy / 400), printf('%.6f', (cx + w) / 400), printf('%.6f', (cy + h) / 400), printf('%.6f', cx / 400), printf('%.6f', (cy + h) / 400))"


def pixel_corners(spark, sf):
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return boxes(spark, sf).withColumn("corners", F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h)))


@query("corners_to_obb", W + f" SELECT image_id, det_id, '0' || substr({LINE}, 2) AS line FROM b")
def corners_to_obb(spark, sf):
    return pixel_corners(spark, sf).select("image_id", "det_id", D.corners_to_obb(F.col("corners"), F.lit(400), F.lit(400)).alias("line"))


@query("obb_to_keypoint", W + """ SELECT image_id, det_id, '0' AS cls, 17 AS fields, CAST(round(2 * cx + w) AS BIGINT) AS x, CAST(round(h) AS BIGINT) AS h FROM b""")
def obb_to_keypoint(spark, sf):
    lines = pixel_corners(spark, sf).select("image_id", "det_id", D.corners_to_obb(F.col("corners"), F.lit(400), F.lit(400)).alias("value"))
    rows = D.obb_to_keypoint(lines).select("image_id", "det_id", F.split("keypoints", " ").alias("parts"))
    at = lambda i: F.col("parts")[i]
    return rows.select("image_id", "det_id", at(0).alias("cls"), F.size("parts").alias("fields"), F.round(at(1).cast("double") * 800).cast("long").alias("x"), F.round(at(4).cast("double") * 400).cast("long").alias("h"))


@query("detect_postprocess", """WITH e AS (SELECT vec_id, vec_id % 7 AS m, CASE WHEN vec_id % 2 = 0 THEN 1e0 ELSE 5e-1 END AS s FROM embeddings)
SELECT vec_id AS image_id, CAST(0.9 AS DOUBLE) AS conf, round((30 + m) / s, 4) AS left, round(30 / s, 4) AS top, round((50 + m) / s, 4) AS right, round(70 / s, 4) AS bottom FROM e
UNION ALL SELECT vec_id, CAST(0.7 AS DOUBLE), CAST(0 AS DOUBLE), round(87 / s, 4), round(6 / s, 4), round(100 / s, 4) FROM e""")
def detect_postprocess(spark, sf):
    """Four boxes per vector, in a square with bars of 10 on both sides, of images of either scale: one stays, one overlaps
    it, one is too weak, and one reaches beyond the image, to which it is cut."""
    v = F.col("vec_id")
    box = lambda *values: [(x if hasattr(x, "cast") else F.lit(x)).cast("float") for x in values]
    data = F.array(*box(v % 7 + 50, 50, 20, 40, 0.9, 0, 0), *box(v % 7 + 52, 50, 20, 40, 0.8, 0, 0), *box(80, 50, 20, 40, 0.1, 0, 0), *box(12, 95, 8, 16, 0.7, 0, 0))
    s = F.when(v % 2 == 0, 1.0).otherwise(0.5)
    frame = {"scale": s, "pad_x": F.lit(10.0), "pad_y": F.lit(0.0), "width": 80 / s, "height": 100 / s}
    raw = T.table(spark, sf, "embeddings").select(v.alias("image_id"), F.array(F.lit(1), F.lit(4), F.lit(7)).alias("dims"), data.alias("data"), *[c.alias(n) for n, c in frame.items()])
    at = lambda i, c: F.round(F.col("corners")[i][c], 4)
    return D.detect_postprocess(raw, 100.0).select("image_id", F.round("conf", 4).alias("conf"), at(0, "x").alias("left"), at(0, "y").alias("top"), at(2, "x").alias("right"), at(2, "y").alias("bottom"))


@query("best_per_image", W + " SELECT image_id, det_id FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) <= 3")
def best_per_image(spark, sf):
    return D.best_per_image(boxes(spark, sf), 3).select("image_id", "det_id")
