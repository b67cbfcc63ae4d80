"""ESRI shapefiles: .shp geometry and .dbf attributes.

Both files are read as binary rows of Spark's own reader, so any store that Spark reads will do. Records of a
shapefile have no marks to start in the middle, so a file is one task; many files
(a folder or a pattern) are many.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .wkb import RINGS

POINTS, POLYGONS, MULTIPOINTS = (1, 11, 21), (5, 15, 25), (8, 18, 28)


def shapes(b: bytes) -> Iterator[list[list[tuple[float, float]]] | None]:
    """The rings of each record of a .shp file; null shapes are None."""
    if struct.unpack_from(">i", b, 0)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(b):
        _, words = struct.unpack_from(">ii", b, at)
        p = at + 8
        (kind,) = struct.unpack_from("<i", b, p)
        if kind == 0:
            yield None
        elif kind in POINTS:
            yield [[struct.unpack_from("<2d", b, p + 4)]]
        elif kind in MULTIPOINTS:
            (n,) = struct.unpack_from("<i", b, p + 36)
            yield [[struct.unpack_from("<2d", b, p + 40 + 16 * k)] for k in range(n)]
        elif kind in POLYGONS:
            parts, n = struct.unpack_from("<2i", b, p + 36)
            first = [*struct.unpack_from(f"<{parts}i", b, p + 44), n]
            v = struct.unpack_from(f"<{2 * n}d", b, p + 44 + 4 * parts)
            yield [[(v[2 * k], v[2 * k + 1]) for k in range(first[r], first[r + 1])] for r in range(parts)]
        else:
            raise ValueError("only points and polygons are layers")
        at = p + 2 * words


def fields(b: bytes) -> list[tuple[str, str, int, int]]:
    """(name, kind, width, decimals) of the columns of a .dbf file."""
    out, at = [], 32
    while at < len(b) and b[at] != 0x0D:
        name = b[at : at + 11].split(b"\0")[0].decode("latin-1").strip()
        out.append((name, chr(b[at + 11]), b[at + 16], b[at + 17]))
        at += 32
    return out


def spark_type(kind: str, decimals: int) -> str:
    return {"N": "double" if decimals else "bigint", "F": "double", "L": "bigint"}.get(kind, "string")


def records(b: bytes) -> Iterator[list]:
    """The rows of a .dbf file; blanks and stars are null."""
    (n,) = struct.unpack_from("<I", b, 4)
    head, size = struct.unpack_from("<HH", b, 8)
    columns = fields(b)
    for k in range(n):
        at, row = head + k * size + 1, []
        for _, kind, width, decimals in columns:
            text = b[at : at + width].decode("utf-8", "replace").strip(" \0")
            at += width
            if not text or set(text) == {"*"}:
                row.append(None)
            elif kind in "NF":
                row.append(float(text) if kind == "F" or decimals else int(float(text)) if "." in text else int(text))
            elif kind == "L":
                row.append({"T": 1, "Y": 1, "F": 0, "N": 0}.get(text.upper()))
            else:
                row.append(text)
        yield row


def packed(polygons: list[list[list[tuple[float, float]]] | None]) -> bytes:
    """A .shp file of polygons, each a list of rings; null shapes are None."""
    body = []
    for k, rings in enumerate(polygons, 1):
        content = struct.pack("<i", 0)
        if rings is not None:
            points = [p for ring in rings for p in ring]
            x, y = [p[0] for p in points], [p[1] for p in points]
            firsts = [sum(len(r) for r in rings[:n]) for n in range(len(rings))]
            content = struct.pack("<i4d2i", 5, min(x), min(y), max(x), max(y), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *firsts) + b"".join(struct.pack("<2d", *p) for p in points)
        body.append(struct.pack(">ii", k, len(content) // 2) + content)
    body = b"".join(body)
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2).ljust(100, b"\0") + body


def packed_table(columns: list[tuple[str, str, int, int]], rows: list[tuple]) -> bytes:
    """A .dbf file of rows of texts; columns as `fields` gives them."""
    head = struct.pack("<B3xIHH20x", 3, len(rows), 32 + 32 * len(columns) + 1, 1 + sum(c[2] for c in columns))
    for name, kind, width, decimals in columns:
        head += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14
    return head + b"\r" + b"".join(b" " + b"".join(v.rjust(c[2]).encode() for v, c in zip(r, columns, strict=True)) for r in rows) + b"\x1a"


def open_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """The layer of one .shp file and the .dbf beside it: id (1, 2 ...), its fields, rings."""
    if not isinstance(path, str):
        raise TypeError("the path must be a string")
    base = path[:-4] if path.lower().endswith(".shp") else path
    files = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.dbf"])
    head = files.where("lower(path) like '%.dbf'").select(F.substring("content", 1, 32 + 32 * 255 + 1).alias("h")).first()
    columns = fields(bytes(head.h))
    one = files.groupBy(F.regexp_replace("path", r"\.[^.]*$", "").alias("base")).agg(*(F.max(F.when(F.lower("path").endswith(e), F.col("content"))).alias(e[1:]) for e in (".shp", ".dbf")))
    names = [c[0] for c in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shp, dbf in zip(pdf["shp"], pdf["dbf"], strict=True):
                rows, k = [], 0
                for rings, values in zip(shapes(bytes(shp)), records(bytes(dbf)), strict=True):
                    k += 1
                    rows.append([k, *values, None if rings is None else [[{"x": x, "y": y} for x, y in r] for r in rings]])
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=["id", *names, "rings"]).astype(object)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["id", *names, "rings"]).astype(object)

    return one.mapInPandas(run, "id bigint, " + "".join(f"`{n}` {spark_type(k, d)}, " for n, k, _, d in columns) + f"rings {RINGS}")
