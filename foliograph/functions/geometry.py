"""Boxes (x0, y0, x1, y1) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Share of the shorter of two intervals that the other covers."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)) / shorter).otherwise(0.0)


def distance(a: list[Column], b: list[Column]) -> Column:
    """Distance of two boxes; 0 if they touch."""
    dx = F.greatest(F.lit(0.0), b[0] - a[2], a[0] - b[2])
    dy = F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3])
    return F.sqrt(dx * dx + dy * dy)


def normalised(box: list[Column], width: Column, height: Column) -> list[Column]:
    return [F.round(v / s, 6) for v, s in zip(box, (width, height, width, height))]


def tag_side(x0: Column, x1: Column) -> Column:
    """Margin of an equation tag in page-normalised coordinates; a box outside of the page, or without width, tells nothing."""
    fits = (x0 >= 0) & (x0 < x1) & (x1 <= 1)
    return F.when(F.coalesce(fits & (x1 <= 0.25), F.lit(False)), "left").when(F.coalesce(fits & (x0 >= 0.75), F.lit(False)), "right").otherwise("unknown")


def common_side(sides: Column) -> Column:
    """The margin that all tags of an array are in: left, right, mixed, unknown as soon as one is, not_applicable without one."""
    distinct = F.array_distinct(sides)
    return F.when(F.size(sides) == 0, "not_applicable").when(F.array_contains(sides, "unknown"), "unknown").when(F.size(distinct) == 1, F.get(distinct, 0)).otherwise("mixed")


def similarity(left: Column, right: Column, top: float = 255.0) -> Column:
    """Structural similarity of two grey images of one size, taken whole, as arrays of equal length: 1 for equal ones."""
    n = F.size(left).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    a, b = left.cast("array<double>"), right.cast("array<double>")
    ma, mb = total(a) / n, total(b) / n
    va = total(F.transform(a, lambda x: x * x)) / n - ma * ma
    vb = total(F.transform(b, lambda x: x * x)) / n - mb * mb
    vab = total(F.zip_with(a, b, lambda x, y: x * y)) / n - ma * mb
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    return F.when(n > 0, ((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2)))


def union(group: str = "") -> list[Column]:
    """Aggregates of the box around all boxes of a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
