"""Column functions over vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is all zeros."""
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """Divided by the norm only if that is positive and off one by more than 1e-4."""
    n = norm(a)
    return F.when((n > 0) & (F.abs(n - 1) > 1e-4), F.transform(a, lambda x: x / n)).otherwise(a.cast("array<double>"))


def pixel_normalize(a: Column | str) -> Column:
    return F.transform(a, lambda p: p / 127.5 - 1)


def similarity_pct(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")
