"""Columns of polygon rings: vertices, edges, area, perimeter, centroid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def segments(rings: Column) -> Column:
    """All edges of all rings, as structs x1, y1, x2, y2; repeated points make none."""
    one = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda k: F.struct(F.get(r, k - 1).x.alias("x1"), F.get(r, k - 1).y.alias("y1"), F.get(r, k).x.alias("x2"), F.get(r, k).y.alias("y2")))
    return F.filter(F.flatten(F.transform(rings, one)), lambda s: s.x2.isNotNull() & ((s.x1 != s.x2) | (s.y1 != s.y2)))


def folded(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, s: a + value(s))


def cross(s: Column) -> Column:
    return s.x1 * s.y2 - s.x2 * s.y1


def area(rings: Column) -> Column:
    """By the shoelace formula; holes run against their outer ring."""
    return F.abs(folded(segments(rings), cross)) / 2


def perimeter(rings: Column) -> Column:
    return folded(segments(rings), lambda s: F.sqrt((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))


def centroid(rings: Column) -> tuple[Column, Column]:
    """Weighted by area; the mean of the vertices where the area is 0."""
    seg = segments(rings)
    twice = folded(seg, cross)
    pts = F.flatten(rings)
    mean = lambda c: F.try_divide(F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[c]), F.size(pts))
    x = F.try_divide(folded(seg, lambda s: (s.x1 + s.x2) * cross(s)), 3 * twice)
    y = F.try_divide(folded(seg, lambda s: (s.y1 + s.y2) * cross(s)), 3 * twice)
    return F.coalesce(x, mean("x")), F.coalesce(y, mean("y"))


def with_points(layer: DataFrame) -> DataFrame:
    """(id, x, y) of a layer: its points, or the centroids of its polygons."""
    if "rings" in layer.columns:
        x, y = centroid(F.col("rings"))
        return layer.select("id", x.alias("x"), y.alias("y"))
    return layer.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
