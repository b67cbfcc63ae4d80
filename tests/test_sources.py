import gzip
import struct

import pytest

from tessera.operators import weights as W
from tessera.sources import shapefile, weights_io as IO, wkb


@pytest.fixture()
def w(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 10)], "id long")
    return W.Weights(nodes, spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (2, 3, 1.25), (3, 2, 1.25)], "i long, j long, w double"))


def edges(w):
    return {tuple(r) for r in w.edges.select("i", "j", "w").collect()}


def test_gal_and_gwt_round_trip(spark, w, tmp_path):
    for kind, read in (("gal", IO.read_gal), ("gwt", IO.read_gwt)):
        assert IO.save_weights(w, str(tmp_path / kind), "map", "ID", kind)
        got = read(spark, str(tmp_path / kind))
        assert {e[:2] for e in edges(got)} == {e[:2] for e in edges(w)}
        if kind == "gwt":
            assert edges(got) == edges(w)
        else:
            assert W.weights_stats(got).first() == W.weights_stats(w).first()
    again = IO.read_gal(spark, str(tmp_path / "gal"), [3, 2])
    assert {e[:2] for e in edges(again)} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        IO.save_weights(w, str(tmp_path / "x"), id_variable="")


def test_gwt_lines_are_made_after_the_sort_and_can_be_compressed(spark, w, tmp_path):
    assert IO.save_weights(w, str(tmp_path / "z"), "map", "ID", "gwt", compression="gzip")
    parts = sorted((tmp_path / "z").glob("part-*"))
    assert parts and all(p.name.endswith(".gz") for p in parts)
    assert "".join(gzip.decompress(p.read_bytes()).decode() for p in parts) == "0 4 map ID\n1 2 0.5\n2 1 0.5\n2 3 1.25\n3 2 1.25\n"
    assert edges(IO.read_gwt(spark, str(tmp_path / "z"))) == edges(w)


def test_string_ids(spark, w, tmp_path):
    names = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (10, "d")], "id long, name string")
    IO.save_weights(w, str(tmp_path / "s"), kind="gal", ids=names)
    assert {e[:2] for e in edges(IO.read_gal(spark, str(tmp_path / "s"), id_type="string"))} == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_swm(spark, tmp_path):
    (tmp_path / "q.swm").write_bytes(IO.packed([(1, [2, 3], [0.5, 0.25]), (2, [], []), (3, [1], [2.0])]))
    got = IO.read_swm(spark, str(tmp_path / "q.swm"))
    assert edges(got) == {(1, 2, 0.5), (1, 3, 0.25), (3, 1, 2.0)} and got.nodes.count() == 3


def test_wkb_round_trip(spark):
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    two = square + [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]
    big = struct.pack(">BI2d", 0, 1, 3.0, 4.0)
    rows = [(1, bytearray(wkb.encoded(wkb.POLYGON, square))), (2, bytearray(wkb.encoded(wkb.MULTIPOLYGON, two))), (3, bytearray(big)), (4, None)]
    layer = wkb.as_layer(spark.createDataFrame(rows, "fid long, g binary"), "fid", "g")
    got = {r.id: r.rings and [[tuple(p) for p in ring] for ring in r.rings] for r in layer.collect()}
    assert got == {1: square, 2: two, 3: [[(3.0, 4.0)]], 4: None}
    again = wkb.as_layer(wkb.with_wkb(layer), "fid", "geom")
    assert {r.id: r.rings and [[tuple(p) for p in ring] for ring in r.rings] for r in again.collect()} == got
    assert wkb.map_type(layer).first()[0] == "map_polygons"
    with pytest.raises(ValueError):
        wkb.decoded(struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1))


def shp(records):
    body = b""
    for k, r in enumerate(records, 1):
        if r is None:
            content = struct.pack("<i", 0)
        else:
            pts = [p for ring in r for p in ring]
            first, n = [], 0
            for ring in r:
                first.append(n)
                n += len(ring)
            content = struct.pack("<i4d2i", 5, 0, 0, 9, 9, len(r), n) + struct.pack(f"<{len(first)}i", *first) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">ii", k, len(content) // 2) + content
    return struct.pack(">i20xi", 9994, (100 + len(body)) // 2).ljust(100, b"\0") + body


def dbf(columns, rows):
    head = struct.pack("<B3xIHH20x", 3, len(rows), 32 + 32 * len(columns) + 1, 1 + sum(c[2] for c in columns))
    for name, kind, width, dec in columns:
        head += name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, dec]) + b"\0" * 14
    return head + b"\r" + b"".join(b" " + b"".join(str(v).rjust(c[2]).encode() if v is not None else b" " * c[2] for v, c in zip(r, columns)) for r in rows) + b"\x1a"


def test_shapefile(spark, tmp_path):
    square = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]
    other = [[(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)], [(1.2, 1.1), (1.3, 1.1), (1.2, 1.2), (1.2, 1.1)]]
    (tmp_path / "m.shp").write_bytes(shp([square, other, None]))
    (tmp_path / "m.dbf").write_bytes(dbf([("NAME", "C", 6, 0), ("N", "N", 8, 0), ("X", "N", 10, 3)], [("a", 1, "1.500"), ("b", None, "-2.250"), (None, 7, None)]))
    layer = shapefile.open_shapefile(spark, str(tmp_path / "m.shp"))
    got = layer.orderBy("id").collect()
    assert [(r.id, r.NAME, r.N, r.X) for r in got] == [(1, "a", 1, 1.5), (2, "b", None, -2.25), (3, None, 7, None)]
    assert [r.rings and [[tuple(p) for p in ring] for ring in r.rings] for r in got] == [square, other, None]
    assert {(r.field, r.type) for r in wkb.layer_info(layer).collect()} == {("id", "integer"), ("NAME", "string"), ("N", "integer"), ("X", "real")}
    assert {tuple(r)[:2] for r in W.queen_weights(layer).edges.collect()} == {(1, 2), (2, 1)}
    with pytest.raises(TypeError):
        shapefile.open_shapefile(spark, 5)


def test_gal_in_blocks(spark, tmp_path):
    """A part that is read in many blocks, whose borders fall anywhere; a row never holds the part."""
    want = {(i, (i * k) % 400) for i in range(400) for k in range(2, 2 + i % 4)}
    for head in ("0 400 layer id\n", "400\r\n", ""):
        text = head + "".join(f"{i} {i % 4}\n{' '.join(str((i * k) % 400) for k in range(2, 2 + i % 4))}\n" for i in range(400))
        (tmp_path / "x.gal").write_bytes(text.encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
        spark.conf.set("spark.sql.files.openCostInBytes", "900b")
        try:
            w = IO.read_gal(spark, str(tmp_path / "x.gal"))
            assert {(r.i, r.j) for r in w.edges.collect()} == want and w.nodes.count() == 400
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
