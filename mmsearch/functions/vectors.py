"""Column functions on array<double> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_WEIGHT, TEXT_WEIGHT = 0.85, 0.15


def as_double(v: Column) -> Column:
    """Vectors rest as float32; all arithmetic is in double."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float | None = None) -> Column:
    """a over its norm. A zero norm counts as 1; with ``least``, a smaller norm counts as ``least``."""
    n = norm(a)
    n = F.when(n == 0, F.lit(1.0)).otherwise(n) if least is None else F.greatest(n, F.lit(least))
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(n, F.size(a)).alias("n")), lambda s: s["x"] / s["n"])


def weigh(img: Column, txt: Column, wi, wt) -> Column:
    """Weighted sum of two vectors; weights are numbers or columns."""
    wi, wt = (w if isinstance(w, Column) else F.lit(float(w)) for w in (wi, wt))
    return F.zip_with(img, txt, lambda x, y: wi * x + wt * y)


def fuse(img: Column, txt: Column, wi=IMAGE_WEIGHT, wt=TEXT_WEIGHT) -> Column:
    return unit(weigh(img, txt, wi, wt))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector is at distance 1 from everything."""
    n = norm(a) * norm(b)
    return F.lit(1.0) - F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
