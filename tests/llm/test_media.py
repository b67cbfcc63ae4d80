import gzip
import hashlib
import io
import struct
import time
import wave
import zlib

from tessera.llm import media as M


def png(w=3, h=2):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes((w + 1) * h))) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x00" + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IHHI", 62, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + bytes(8)
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n"
GZ = gzip.compress(b"text " * 50, mtime=0)
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 4) + b"WEBPVP8L" + struct.pack("<I", 4) + b"abcd"
ALL = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/gzip": GZ, "image/webp": WEBP, "audio/wav": M.wav(b"\x80" * 10)}


def test_types_are_found_and_damage_is_not():
    a = M.automaton()
    for kind, b in ALL.items():
        found = M.objects(b, a)
        assert found and found[0] == (kind, 0, len(b)) and M.true_type(b, found) == kind, kind
        if kind != "application/pdf":
            assert M.true_type(b[: len(b) - 3], M.objects(b[: len(b) - 3], a)) is None, kind
    bad = bytearray(png())
    bad[-20] ^= 1
    assert M.objects(bytes(bad), a) == []
    assert M.objects(b"BM RIFF GIF89a %PDF- \xff\xd8\xff \x1f\x8b\x08 text", a) == []


def test_validators_take_linear_time():
    a, n = M.automaton(), 60000
    for raw in (b"%PDF-1 " * n, PDF * n, (b"\xff\xd8\xff\xda\x00\x02" + b"x" * 20) * n, (b"GIF89a" + bytes(7) + b"\x21\x01\x05") * n, (JPEG[:-2] + JPEG[8:-2]) * (n // 4), b"GIF89a" + bytes(7) + b"\x21\xff\x01a" * n):
        began = time.monotonic()
        M.objects(raw, a)
        assert time.monotonic() - began < 15


def test_correction_and_carving(spark):
    body = b"..".join(ALL[k] for k in ("image/png", "image/gif", "image/bmp", "application/gzip"))
    rows = [(1, "image/jpeg", bytearray(png())), (2, "x", bytearray(b"junk" + body + b"tail of more than sixteen bytes")), (3, "y", None), (4, "z", bytearray(b""))]
    df = spark.createDataFrame(rows, "id long, type string, media binary")
    got = {r.id: r for r in M.sniffed(df, ["id", "type"]).collect()}
    assert got[1].media_type == "image/png" and got[1].embedded == [] and got[1].type == "image/jpeg"
    assert [r.media_type for r in (got[2], got[3], got[4])] == [None] * 3
    carved = {r.type: bytes(r.object) for r in M.carved(df.drop("type"), ["id"]).collect()}
    assert carved == {k: ALL[k] for k in ("image/png", "image/gif", "image/bmp", "application/gzip")}


def test_round_trip(spark):
    pdf = PDF.decode()
    rows = [(1, None), (2, ""), (3, "a" * 576), (4, "é" * 288 + "b"), (5, "BM RIFF WAVE GIF89a text"), (6, "x" * 200_001), (6, "x" * 200_001), (7, "é" + pdf + "..." + pdf + "end")]
    got = M.features(M.stored(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        w = wave.open(io.BytesIO(M.wav(full)))
        assert w.getsampwidth() == 1 and w.readframes(w.getnframes()) == full
        assert (r.media_bytes, r.media_sha256) == (len(full) + 44, hashlib.sha256(M.wav(full)).hexdigest())
        inside = f"application/pdf@46+{2 * len(PDF) + 3},application/pdf@{49 + len(PDF)}+{len(PDF)}" if r.doc_id == 7 else ""
        assert r.feature == f"audio/wav;frames={len(full)};mean={sum(full) * 1000 // len(full)};peak={max(abs(x - 128) for x in full)};embedded={inside}"
        assert (r.declared, r.media_type) == ("text/plain", "audio/wav")
    assert M.features(M.stored(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
