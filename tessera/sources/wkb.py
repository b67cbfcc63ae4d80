"""Geometry columns: well-known binary to rings or points, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = 1, 2, 3, 4, 5, 6
RINGS = "array<array<struct<x: double, y: double>>>"


def decoded(b: bytes, at: int = 0) -> tuple[int, list[list[tuple[float, float]]], int]:
    """(kind, rings, end): points are rings of one point. Z and M values are left out."""
    order = "<" if b[at] else ">"
    (raw,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if raw & 0x20000000:
        at += 4  # a spatial reference
    kind = raw & 0xFFFF
    size = 2 + bool(raw & 0x80000000) + bool(raw & 0x40000000)
    if kind >= 1000:
        size += {1: 1, 2: 1, 3: 2}.get(kind // 1000, 0)
        kind %= 1000

    def points(n: int, at: int) -> tuple[list[tuple[float, float]], int]:
        v = struct.unpack_from(f"{order}{n * size}d", b, at)
        return [(v[k * size], v[k * size + 1]) for k in range(n)], at + 8 * n * size

    if kind == POINT:
        p, at = points(1, at)
        return kind, [p], at
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    rings: list[list[tuple[float, float]]] = []
    if kind == POLYGON:
        for _ in range(n):
            (m,) = struct.unpack_from(order + "I", b, at)
            p, at = points(m, at + 4)
            rings.append(p)
    elif kind in (MULTIPOINT, MULTIPOLYGON):
        for _ in range(n):
            _, more, at = decoded(b, at)
            rings += more
    else:
        raise ValueError("only points and polygons are layers")
    return kind, rings, at


def encoded(kind: int, rings: list[list[tuple[float, float]]]) -> bytes:
    """Little-endian WKB; a MULTIPOLYGON has a polygon per ring."""
    flat = lambda r: struct.pack(f"<{2 * len(r)}d", *(v for p in r for v in p))
    if kind == POINT:
        return struct.pack("<BI", 1, POINT) + flat(rings[0])
    if kind == POLYGON:
        return struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(struct.pack("<I", len(r)) + flat(r) for r in rings)
    part = POINT if kind == MULTIPOINT else POLYGON
    return struct.pack("<BII", 1, kind, len(rings)) + b"".join(encoded(part, [r]) for r in rings)


def as_layer(df: DataFrame, id_column: str, geometry: str) -> DataFrame:
    """df with `id` and `rings` from a binary WKB column; rows of points have rings of one point.

    Null geometry has null rings. Lines are refused.
    """
    if dict(df.dtypes)[geometry] != "binary":
        raise ValueError(f"{geometry} must be binary WKB")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rings = [None if g is None else [[{"x": x, "y": y} for x, y in r] for r in decoded(bytes(g))[1]] for g in pdf[geometry]]
            yield pdf.drop(columns=[geometry]).assign(rings=rings)

    rest = [c for c in df.columns if c != geometry]
    kinds = dict(df.dtypes)
    out = df.select(*rest, geometry).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", rings {RINGS}")
    return out if id_column == "id" else out.withColumn("id", F.col(id_column))


def point_layer(layer: DataFrame) -> DataFrame:
    """A layer whose rings are single points, with x and y."""
    p = F.get(F.get("rings", F.lit(0)), F.lit(0))
    return layer.withColumn("x", p.x).withColumn("y", p.y).drop("rings")


def map_type(layer: DataFrame) -> DataFrame:
    """One row: map_points or map_polygons."""
    most = F.max(F.size(F.get("rings", F.lit(0))))
    return layer.agg(F.when(most > 1, "map_polygons").otherwise("map_points").alias("map_type"))


def with_wkb(layer: DataFrame, name: str = "geom") -> DataFrame:
    """layer with its rings as WKB: POINT for a single point, POLYGON for one ring, else MULTIPOLYGON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rings in pdf["rings"]:
                if rings is None:
                    out.append(None)
                    continue
                r = [[(p["x"], p["y"]) for p in ring] for ring in rings]
                out.append(encoded(POINT if len(r) == 1 and len(r[0]) == 1 else POLYGON if len(r) == 1 else MULTIPOINT if all(len(x) == 1 for x in r) else MULTIPOLYGON, r))
            yield pdf.drop(columns=["rings"]).assign(**{name: out})

    rest = [c for c in layer.columns if c != "rings"]
    kinds = dict(layer.dtypes)
    return layer.select(*rest, "rings").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", `{name}` binary")


def layer_info(layer: DataFrame) -> DataFrame:
    """(position, field, type): the attribute columns, as integer, real or string."""
    kind = lambda t: "integer" if t in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if t in ("float", "double") or t.startswith("decimal") else "string"
    rows = [(k, c, kind(t)) for k, (c, t) in enumerate((c, t) for c, t in layer.dtypes if c not in ("rings", "geom"))]
    return layer.sparkSession.createDataFrame(rows, "position int, field string, type string")


def undefined_values(layer: DataFrame, column: str) -> DataFrame:
    """(id, undefined)."""
    return layer.select("id", F.col(column).isNull().alias("undefined"))


def as_data_frame(layer: DataFrame) -> DataFrame:
    """The attributes without the geometry."""
    return layer.drop("rings", "geom")
