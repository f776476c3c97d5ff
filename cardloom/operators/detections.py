"""Post-processing of detector output as tables: decode, filter, suppress overlaps, rotate, corners and label lines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE, OVERLAP, MOST = 0.35, 0.5, 12
BOX = ("cx", "cy", "w", "h", "angle", "conf")
#: How an image was fitted into the model's square, and its own size in pixels.
LETTERBOX = ("scale", "pad_x", "pad_y", "width", "height")


def decode_detections(raw: DataFrame) -> DataFrame:
    """raw (image_id, dims, data) to image_id, det_id, cx, cy, w, h, angle, conf. Layouts: [1, n, 7] (confidence at 4, angle
    at 6) and [1, 6, n] (confidence at 4, angle at 5); others raise. Columns of ``LETTERBOX`` are carried along."""
    d = lambda i: F.col("dims")[i]
    rows_first, columns_first = d(2) == 7, d(1) == 6
    n = F.when(rows_first, d(1)).when(columns_first, d(2)).otherwise(F.raise_error(F.lit("unknown layout of detections")).cast("int"))
    rows = raw.withColumn("n", n).filter("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("det_id"))
    at = lambda i, j: F.element_at("data", (F.when(rows_first, F.col("det_id") * 7 + i).otherwise(F.lit(j) * F.col("n") + F.col("det_id")) + 1).cast("int")).cast("double")
    return rows.select("image_id", "det_id", at(0, 0).alias("cx"), at(1, 1).alias("cy"), at(2, 2).alias("w"), at(3, 3).alias("h"), at(6, 5).alias("angle"), at(4, 4).alias("conf"), *[c for c in LETTERBOX if c in raw.columns])


def filter_detections(dets: DataFrame, confidence: float = CONFIDENCE, size: float | None = None) -> DataFrame:
    """Confident, finite boxes larger than one pixel whose centre lies in the image (of that size)."""
    ok = (F.col("conf") >= confidence) & (F.col("w") > 1) & (F.col("h") > 1)
    for c in BOX:
        ok = ok & ~F.isnan(c) & (F.abs(c) < math.inf)
    if size is not None:
        ok = ok & F.col("cx").between(0, size) & F.col("cy").between(0, size)
    return dets.filter(ok)


def envelope(w: Column, h: Column, angle: Column) -> tuple[Column, Column]:
    """Half sizes of the upright box around a rotated one."""
    c, s = F.abs(F.cos(angle)), F.abs(F.sin(angle))
    return (w * c + h * s) / 2, (w * s + h * c) / 2


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one box (x0, y0, x1, y1) with others."""
    wide = np.clip(np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]), 0, None)
    high = np.clip(np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]), 0, None)
    both = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _greedy(boxes: np.ndarray, overlap: float, most: int | None) -> list[int]:
    """Which of one image's boxes, best first, stay."""
    kept: list[int] = []
    for i in range(len(boxes)):
        if most is not None and len(kept) == most:
            break
        if not kept or not (_iou(boxes[i], boxes[kept]) > overlap).any():
            kept.append(i)
    return kept


#: Images of so many boxes at most are judged together, place by place; with more, each by itself.
FEW = 32


def _greedy_together(boxes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, overlap: float, most: int | None) -> np.ndarray:
    """``_greedy`` of many small images at once, whose boxes follow one another: the flag of each box. In each step the boxes
    of one place meet those of an earlier place, in all images that have so many."""
    stays, held = np.zeros(len(boxes), dtype=bool), np.zeros(len(starts), dtype=np.int64)
    for place in range(int(sizes.max(initial=0))):
        image = np.flatnonzero(sizes > place)
        at = starts[image] + place
        free = np.ones(len(image), dtype=bool) if most is None else held[image] < most
        for other in range(place):
            i = np.flatnonzero(free & stays[at - place + other])
            free[i[_iou(boxes[at[i]].T, boxes[at[i] - place + other]) > overlap]] = False
        stays[at] = free
        held[image] += free
    return stays


def nms(dets: DataFrame, overlap: float = OVERLAP, most: int | None = None) -> DataFrame:
    """Greedy by confidence (ties by det_id): a box stays if it overlaps no kept one of its image by more.

    One shuffle by image; within a partition images follow one another, sorted, so a batch holds many of them, and only
    the last one of a batch is carried over to the next.
    """
    half_w, half_h = envelope(F.col("w"), F.col("h"), F.col("angle"))
    rows = dets.withColumns({"_hw": half_w, "_hh": half_h})
    columns = dets.columns

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        x, y, hw, hh = (frame[c].to_numpy() for c in ("cx", "cy", "_hw", "_hh"))
        boxes = np.stack([x - hw, y - hh, x + hw, y + hh], axis=1)
        image = frame["image_id"].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(image[1:] != image[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(image)))
        few = sizes <= FEW
        kept = _greedy_together(boxes, starts[few], sizes[few], overlap, most)
        for a, n in zip(starts[~few], sizes[~few], strict=True):
            kept[a + np.array(_greedy(boxes[a : a + n], overlap, most), dtype=np.int64)] = True
        return frame[kept][columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []  # the parts of the last image seen, joined once it is whole
        for frame in frames:
            if not len(frame):
                continue
            image = frame["image_id"].to_numpy()
            last = image == image[-1]
            if open_ and (image[0] != open_[0]["image_id"].iloc[0] or not last.all()):
                own = image == open_[0]["image_id"].iloc[0]
                yield finished(pd.concat([*open_, frame[own]], ignore_index=True))
                open_, frame, last = [], frame[~own], last[~own]
            if len(frame[~last]):
                yield finished(frame[~last])
            open_.append(frame[last])
        if open_:
            yield finished(pd.concat(open_, ignore_index=True))

    return rows.repartition("image_id").sortWithinPartitions("image_id", F.desc("conf"), "det_id").mapInPandas(run, dets.schema)


#: The least and largest power of two that a box's level can be, and cells between the origin and any box, as a power of two.
LEVELS, FAR = (-1000, 1000), 50


def _cells(level: Column) -> Column:
    """The cells of a level, squares of side 2 to the level, that a box touches; four at most, at its own level or above."""
    side = F.pow(F.lit(2.0), level)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))
    return F.flatten(F.transform(span("x0", "x1"), lambda x: F.transform(span("y0", "y1"), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _iou_of(met: DataFrame) -> DataFrame:
    """Pairs (the second box's columns begin with ``_``) whose boxes overlap: image_id, a, b, iou."""
    both = (F.least("_x1", "x1") - F.greatest("_x0", "x0")) * (F.least("_y1", "y1") - F.greatest("_y0", "y0"))
    area = lambda t: (F.col(f"{t}x1") - F.col(f"{t}x0")) * (F.col(f"{t}y1") - F.col(f"{t}y0"))
    ids = F.least("_det_id", "det_id").alias("a"), F.greatest("_det_id", "det_id").alias("b")
    rows = met.select("image_id", *ids, both.alias("_i"), (area("") + area("_") - both).alias("_u")).filter("_i > 0")
    return rows.select("image_id", "a", "b", F.when(F.col("_u") > 0, F.col("_i") / F.col("_u")).otherwise(0.0).alias("iou"))


def _overlap() -> Column:
    return (F.col("_x0") < F.col("x1")) & (F.col("x0") < F.col("_x1")) & (F.col("_y0") < F.col("y1")) & (F.col("y0") < F.col("_y1"))


SIDES = ("x0", "y0", "x1", "y1")


def pairwise_iou(dets: DataFrame) -> DataFrame:
    """All pairs of one image's boxes that overlap: image_id, a, b, iou. Boxes that aren't finite, or have no area, overlap
    none. Boxes of an image of ``FEW`` or fewer meet each other, dealt by image; those of larger ones meet on a grid."""
    half_w, half_h = envelope(F.col("w"), F.col("h"), F.col("angle"))
    box = dets.select("image_id", "det_id", (F.col("cx") - half_w).alias("x0"), (F.col("cy") - half_h).alias("y0"), (F.col("cx") + half_w).alias("x1"), (F.col("cy") + half_h).alias("y1"))
    finite = reduce(lambda p, q: p & q, [F.abs(c) < 1e300 for c in SIDES])  # not so for NaN either
    box = box.filter(finite & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    box = box.withColumn("_n", F.count("*").over(Window.partitionBy("image_id")))
    few, many = box.filter(F.col("_n") <= FEW).drop("_n"), box.filter(F.col("_n") > FEW).drop("_n")
    other = few.withColumnsRenamed({c: f"_{c}" for c in ("det_id", *SIDES)})
    direct = few.join(other.hint("merge"), "image_id").filter((F.col("_det_id") < F.col("det_id")) & _overlap())
    return _iou_of(direct).unionByName(_iou_by_grid(many.repartition("image_id", "det_id")))


def _iou_by_grid(box: DataFrame) -> DataFrame:
    """A spatial join on a grid with a level for each size of box: a box lies in the cells of its own level that it touches, and
    asks in those of its level and of each coarser one that the table has, so boxes of any sizes meet in an equi-join on
    (image, level, cell), a pair where both overlap, and only in the cell that holds the corner where their overlap begins.
    Rows per box: four a level at most, whatever the number of boxes."""
    power = lambda v: F.ceil(F.log2(v)).cast("int")
    level = power(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    out = power(F.greatest(*[F.abs(c) for c in SIDES])) - FAR
    box = box.withColumn("level", F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.greatest(level, out))))
    levels = box.groupBy("image_id").agg(F.array_sort(F.collect_set("level")).alias("levels"))  # as many as LEVELS has, at most
    held = box.select("*", F.explode(_cells(F.col("level"))).alias("cell"))
    asks = box.join(levels, "image_id").withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    asks = asks.select("*", F.explode(_cells(F.col("at"))).alias("cell")).withColumnsRenamed({c: f"_{c}" for c in ("det_id", *SIDES, "level")})
    met = asks.withColumnRenamed("at", "level").join(held, ["image_id", "level", "cell"])
    # Of boxes of one level each meets the other; of others the finer one asks.
    met = met.filter((F.col("_level") < F.col("level")) & (F.col("_det_id") != F.col("det_id")) | (F.col("_det_id") < F.col("det_id")))
    side = F.pow(F.lit(2.0), F.col("level"))
    begin = lambda axis: F.floor(F.greatest(f"_{axis}0", f"{axis}0") / side)
    return _iou_of(met.filter(_overlap()).filter((F.col("cell.x") == begin("x")) & (F.col("cell.y") == begin("y"))))


def unletterbox(dets: DataFrame) -> DataFrame:
    """Boxes in the model's square to the image's own pixels."""
    scaled = {c: F.col(c) / F.col("scale") for c in ("w", "h")}
    return dets.withColumns({"cx": (F.col("cx") - F.col("pad_x")) / F.col("scale"), "cy": (F.col("cy") - F.col("pad_y")) / F.col("scale")} | scaled)


def normalize_portrait(dets: DataFrame) -> DataFrame:
    """Wide boxes turn a quarter; angles come to lie in (-pi/2, pi/2]."""
    wide = F.col("w") > F.col("h")
    turned = F.when(wide, F.col("angle") + math.pi / 2).otherwise(F.col("angle"))
    wrapped = turned - math.pi * F.ceil((turned - math.pi / 2) / math.pi)
    return dets.withColumns({"w": F.least("w", "h"), "h": F.greatest("w", "h"), "angle": wrapped})


def box_corners(dets: DataFrame, width: Column | float | None = None, height: Column | float | None = None) -> DataFrame:
    """Adds corners: top left, top right, bottom right, bottom left of the rotated box, clamped to the image if it is given."""
    c, s = F.cos("angle"), F.sin("angle")
    clamp = lambda v, most: v if most is None else F.least(F.greatest(v, F.lit(0.0)), most if isinstance(most, Column) else F.lit(float(most)))

    def corner(a: int, b: int) -> Column:
        dx, dy = a * F.col("w") / 2, b * F.col("h") / 2
        return F.struct(clamp(F.col("cx") + dx * c - dy * s, width).alias("x"), clamp(F.col("cy") + dx * s + dy * c, height).alias("y"))

    return dets.withColumn("corners", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))


def detect_postprocess(raw: DataFrame, size: float, confidence: float = CONFIDENCE, overlap: float = OVERLAP, most: int = MOST) -> DataFrame:
    """Oriented boxes in pixels of the image. ``size`` is the model's square; raw has the columns of ``LETTERBOX``, or none
    of them where its images are such squares themselves."""
    given = [c for c in LETTERBOX if c in raw.columns]
    if given and len(given) < len(LETTERBOX):
        raise ValueError(f"of {LETTERBOX}, only {given} are given")
    kept = nms(filter_detections(decode_detections(raw), confidence, size), overlap, most)
    if not given:
        return box_corners(normalize_portrait(kept), size, size)
    return box_corners(normalize_portrait(unletterbox(kept)), F.col("width").cast("double"), F.col("height").cast("double")).drop(*LETTERBOX)


def order_corners(corners: Column) -> Column:
    """Of any four points: the least and largest x + y are top left and bottom right, the least and largest y - x top right
    and bottom left; the first of equals."""
    keyed = lambda key: F.transform(corners, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p")))
    least = lambda key: F.array_min(keyed(key))["p"]
    return F.array(least(lambda p: p["x"] + p["y"]), least(lambda p: p["y"] - p["x"]), least(lambda p: -(p["x"] + p["y"])), least(lambda p: p["x"] - p["y"]))


def corner_errors(rows: DataFrame) -> DataFrame:
    """rows (detected, gt: four points each): distances, their mean and largest, and whether each lies nearer to the true
    centre than its truth."""
    gap = F.zip_with("detected", "gt", lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    mean = lambda axis: F.aggregate("gt", F.lit(0.0), lambda s, p: s + p[axis]) / 4
    rows = rows.withColumns({"_x": mean("x"), "_y": mean("y"), "errors": gap})
    inside = F.zip_with("detected", "gt", lambda a, b: F.hypot(a["x"] - F.col("_x"), a["y"] - F.col("_y")) < F.hypot(b["x"] - F.col("_x"), b["y"] - F.col("_y")))
    total = F.aggregate("errors", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumns({"mean_error": total / F.size("errors"), "max_error": F.array_max("errors"), "inside": inside}).drop("_x", "_y")


def _clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def _six(shares: Column) -> Column:
    """An array of numbers in [0, 1] as text with six decimals, half up as ``%.6f`` has it, without a formatter for each."""
    return shares.cast("array<decimal(7,6)>").cast("array<string>")


def _six_texts(shares: np.ndarray) -> pa.Array:
    """``_six`` of a batch: up goes what isn't below the double that stands for the middle."""
    n = np.floor(shares * 1e6)
    n = (n + (shares >= (2 * n + 1) / 2e6)).astype(np.int64)
    digits = pc.utf8_slice_codeunits(pa.array(n + 1_000_000).cast(pa.string()), 1)
    return pc.binary_join_element_wise(pc.if_else(pa.array(n < 1_000_000), "0.", "1."), digits, "")


def _keypoints(lines: pa.Array) -> pa.Array:
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(lines))
    wrong = pc.fill_null(pc.not_equal(pc.list_value_length(parts), 9), True)
    if pc.any(wrong).as_py():
        raise ValueError(f"not nine fields: {lines.filter(wrong)[0].as_py()}")
    rows, fields = len(lines), parts.flatten()
    field = lambda i: fields.take(pa.array(np.arange(i, 9 * rows, 9)))
    at = np.array([field(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(1, 9)]).reshape(4, 2, rows)
    at = np.where(np.isnan(at), np.inf, at)  # the largest of numbers, as Spark orders them
    x, y = at[:, 0], at[:, 1]
    with np.errstate(invalid="ignore"):
        keys = [np.where(np.isnan(k), np.inf, k).argmin(axis=0) for k in (x + y, y - x, -(x + y), x - y)]
    low, high = np.clip(at.min(axis=0), 0, 1), np.clip(at.max(axis=0), 0, 1)
    numbers = np.concatenate([(low + high) / 2, high - low, np.clip(at, 0, 1).reshape(8, rows)])
    texts = _six_texts(numbers.reshape(-1))
    row, two = np.arange(rows), pa.scalar("2")
    text = lambda place: texts.take(pa.array(place * rows + row))
    marks = [c for k in keys for c in (text(4 + 2 * k), text(5 + 2 * k), two)]
    return pc.binary_join_element_wise(field(0), *[text(i) for i in range(4)], *marks, " ")


def obb_to_keypoint(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``keypoints``: a label line of class and four corners as class, clamped box, and the corners in order (that of
    ``order_corners``) with visibility 2; another number of fields raises. Lines are taken apart and written by the batch:
    as columns, a line's twenty numbers make a method that is too long for the JVM to compile."""
    return lines.withColumn("keypoints", F.arrow_udf(_keypoints, "string")(F.col(line)))


def corners_to_obb(corners: Column, width: Column, height: Column, cls: int = 0) -> Column:
    """A label line from corners in pixels."""
    shares = lambda p: [_clamp(p["x"] / width), _clamp(p["y"] / height)]
    four = F.array(*[v for i in range(4) for v in shares(F.get(corners, F.lit(i)))])
    more = F.flatten(F.transform(corners, lambda p: F.array(*shares(p))))
    return F.concat_ws(" ", F.lit(str(cls)), _six(F.when(F.size(corners) == 4, four).otherwise(more)))


def best_per_image(dets: DataFrame, most: int = MOST) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "det_id"))
    return dets.withColumn("place", place).filter(F.col("place") <= most)
