"""Media columns: signature sniffing and carving.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a binary
value. Behind each hit a validator of the format confirms structure and lengths and says
where the object ends. An object that fills the whole value gives its true type, which
corrects a declared one; objects inside others are carved out. An object inside one that is
already found is reported too, as embedded; hits without a valid structure count for nothing.

A null or empty value has no type and no objects. Of hits at one place the longest valid
object wins; ties go to the format listed first.

A payload is stored losslessly as the 8-bit samples of a RIFF WAVE file (one channel).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

RATE, UNIT, FILL = 8000, 576, 255


class Value:
    """A binary value, and what validators have found out about places in it, so that several hits on one structure don't walk it twice."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.b = raw, memoryview(raw)
        self.known: dict[tuple, int] = {}
        self._pdf: tuple[int, int] | None = None

    def walked(self, kind: str, at: int, step: Callable[[int], tuple[int, int | None]]) -> int:
        """The end of a structure walked from `at`; step gives the next place, and the end (-1: not valid) or None to go on."""
        seen, p, end = [], at, None
        while end is None and (kind, p) not in self.known:
            seen.append(p)
            p, end = step(p)
        end = self.known[kind, p] if end is None else end
        self.known.update(((kind, x), end) for x in seen)
        return end

    def pdf(self) -> tuple[int, int]:
        """The places of the last end mark and of the last cross-reference before it."""
        if self._pdf is None:
            k = self.raw.rfind(b"%%EOF")
            self._pdf = k, self.raw.rfind(b"startxref", 0, k) if k >= 0 else -1
        return self._pdf


def png_end(v: Value, at: int) -> int:
    """After the last chunk of a PNG whose chunks have right lengths and sums; else -1."""
    b = v.b

    def step(p: int) -> tuple[int, int | None]:
        n = int.from_bytes(b[p : p + 4], "big")
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return p, -1
        return p + 12 + n, p + 12 + n if bytes(b[p + 4 : p + 8]) == b"IEND" else None

    return v.walked("png", at + 8, step) if bytes(b[at + 8 : at + 16]) == b"\0\0\0\x0dIHDR" else -1


def gif_end(v: Value, at: int) -> int:
    """After the trailer of a GIF whose blocks can be walked."""
    b, p = v.b, at + 13
    if p > len(b):
        return -1
    if b[at + 10] & 128:
        p += 3 * (2 << (b[at + 10] & 7))

    def rows(p: int) -> tuple[int, int | None]:
        """Over one run of data; ends at the byte after the empty one."""
        if p >= len(b):
            return p, -1
        return (p + b[p] + 1, None) if b[p] else (p, p + 1)

    def step(p: int) -> tuple[int, int | None]:
        if p >= len(b):
            return p, -1
        kind = b[p]
        if kind == 0x3B:
            return p, p + 1
        if kind == 0x21:
            p += 2
        elif kind == 0x2C and p + 10 <= len(b):
            p += 11 + (3 * (2 << (b[p + 9] & 7)) if b[p + 9] & 128 else 0)
        else:
            return p, -1
        p = v.walked("gif data", p, rows)
        return p, -1 if p < 0 else None

    return v.walked("gif", p, step)


MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def jpeg_end(v: Value, at: int) -> int:
    """After the end marker of a JPEG whose segments can be walked and that has a scan."""
    b = v.b

    def step(p: int, scanned: bool) -> tuple[int, int | None]:
        if p + 2 > len(b) or b[p] != 0xFF:
            return p, -1
        kind = b[p + 1]
        if kind == 0xD9:
            return p, p + 2 if scanned else -1
        if kind == 0xFF:
            return p + 1, None
        if 0xD0 <= kind <= 0xD7 or kind == 1:
            return p + 2, None
        if kind in (0, 0xD8) or p + 4 > len(b):
            return p, -1
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        if kind != 0xDA:
            return p, None
        m = MARKER.search(v.raw, p)
        if not m or scanned:
            return (m.start(), None) if m else (p, -1)
        return p, v.walked("jpeg scanned", m.start(), lambda p: step(p, True))

    return v.walked("jpeg", at + 2, lambda p: step(p, False))


def riff_chunks(b: memoryview, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, size) of the chunks of a RIFF form; stops with size -1 where one goes past its end."""
    stop = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if stop > len(b):
        yield b"", at, -1
        return
    p = at + 12
    while p < stop:
        n = int.from_bytes(b[p + 4 : p + 8], "little") if p + 8 <= stop else -1
        if n < 0 or p + 8 + n > stop:
            yield b"", p, -1
            return
        yield bytes(b[p : p + 4]), p + 8, n
        p += 8 + n + (n & 1)


def riff_end(form: bytes, needed: set[bytes]) -> Callable[[Value, int], int]:
    def end(v: Value, at: int) -> int:
        b = v.b
        if at + 12 > len(b) or bytes(b[at + 8 : at + 12]) != form:
            return -1
        found = list(riff_chunks(b, at))
        if any(n < 0 for _, _, n in found) or not {k for k, _, _ in found} & needed:
            return -1
        if form == b"WAVE" and [k for k, _, n in found if k == b"fmt " and n >= 16] == []:
            return -1
        return at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")

    return end


def bmp_end(v: Value, at: int) -> int:
    """After a bitmap whose sizes fit each other."""
    b = v.b
    if at + 54 > len(b):
        return -1
    size, data, head = (int.from_bytes(b[at + k : at + k + 4], "little") for k in (2, 10, 14))
    if bytes(b[at + 6 : at + 10]) != bytes(4) or head not in (40, 52, 56, 108, 124) or not 14 + head <= data <= size or at + size > len(b):
        return -1
    w, h, planes, depth, kind = struct.unpack_from("<iiHHI", b, at + 18)
    if w <= 0 or h == 0 or planes != 1 or depth not in (1, 4, 8, 16, 24, 32):
        return -1
    return at + size if kind or data + (w * depth + 31) // 32 * 4 * abs(h) <= size else -1


def gzip_end(v: Value, at: int) -> int:
    """After a gzip member that can be unpacked and whose sum is right."""
    b = v.b
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            piece = b[p : p + 65536]
            d.decompress(piece, 1 << 20)
            while d.unconsumed_tail:
                d.decompress(d.unconsumed_tail, 1 << 20)
            p += len(piece)
    except zlib.error:
        return -1
    return p - len(d.unused_data) if d.eof else -1


def pdf_end(v: Value, at: int) -> int:
    """After the last end mark of a PDF with a cross-reference."""
    k, reference = v.pdf()
    if reference < at:
        return -1
    k += 5
    return k + (2 if v.raw[k : k + 2] == b"\r\n" else v.raw[k : k + 1] in (b"\n", b"\r"))


#: Fixed values of the formats: type, magic bytes, validator.
FORMATS: list[tuple[str, bytes, Callable[[Value, int], int]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", png_end),
    ("image/jpeg", b"\xff\xd8\xff", jpeg_end),
    ("image/gif", b"GIF87a", gif_end),
    ("image/gif", b"GIF89a", gif_end),
    ("audio/wav", b"RIFF", riff_end(b"WAVE", {b"data"})),
    ("image/webp", b"RIFF", riff_end(b"WEBP", {b"VP8 ", b"VP8L", b"VP8X"})),
    ("image/bmp", b"BM", bmp_end),
    ("application/gzip", b"\x1f\x8b\x08", gzip_end),
    ("application/pdf", b"%PDF-", pdf_end),
]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic in {m for _, m, _ in FORMATS}:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def objects(value: bytes, a: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid object in value, by start."""
    v, out = Value(value), []
    for last, magic in a.iter(value.decode("latin-1")):
        at = last - len(magic) + 1
        found = [(end - at, -k, kind) for k, (kind, m, check) in enumerate(FORMATS) if m == magic and (end := check(v, at)) > at]
        if found:
            n, _, kind = max(found)
            out.append((kind, at, n))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def true_type(value: bytes, found: list[tuple[str, int, int]]) -> str | None:
    """The type of an object that begins the value, unless more than a small tail follows it."""
    return next((k for k, at, n in found if at == 0 and n + 16 >= len(value)), None)


def sniffed(media: DataFrame, keep: list[str], value: str = "media") -> DataFrame:
    """The keep columns with media_type (null: none found) and embedded array<struct<type, start, n>> of a binary column."""
    C.small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            types, inside = [], []
            for v in batch.column(value):
                raw = v.as_py() or b""
                found = objects(raw, a)
                types.append(true_type(raw, found))
                inside.append([{"type": k, "start": s, "n": n} for k, s, n in found if s or types[-1] is None])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(types, pa.string()), pa.array(inside, kind)], names=[*keep, "media_type", "embedded"])

    kinds = dict(media.dtypes)
    return media.select(*keep, F.col(value)).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", media_type string, embedded array<struct<type: string, start: long, n: long>>")


def carved(media: DataFrame, keys: list[str], value: str = "media") -> DataFrame:
    """A row for each embedded object: the key columns, type, start, n and its bytes (object)."""
    C.small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            for i, v in enumerate(batch.column(value)):
                raw = v.as_py() or b""
                found = objects(raw, a)
                whole = true_type(raw, found)
                rows = [(k, s, n) for k, s, n in found if s or whole is None]
                if rows:
                    own = [batch.column(k).slice(i, 1).take(pa.array([0] * len(rows))) for k in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([raw[s : s + n] for _, s, n in rows], pa.binary())], names=[*keys, "type", "start", "n", "object"])

    kinds = dict(media.dtypes)
    return media.select(*keys, F.col(value)).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", type string, start long, n long, object binary")


def wav(payload: bytes) -> bytes:
    """payload (of even length) as the samples of an 8-bit mono WAVE file."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes, a: ahocorasick.Automaton) -> tuple[bytes, str, list[tuple[str, int, int]]]:
    """The sample bytes, the type and the objects inside, of stored media whose type is found by sniffing."""
    found = objects(media, a)
    kind = true_type(media, found)
    if kind != "audio/wav":
        raise ValueError(f"stored media is {kind}")
    b = memoryview(media)
    return next(bytes(b[p : p + n]) for k, p, n in riff_chunks(b, 0) if k == b"data"), kind, [x for x in found if x[1]]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): texts as UTF-8 (null: empty), filled up with 255 to a positive multiple of UNIT, stored as media; the type they declare is wrong on purpose."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            media = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                n = b - a
                media.append(wav(data[a:b].tobytes() + bytes([FILL]) * (max(1, -(-n // UNIT)) * UNIT - n)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs), pa.int64()), pa.array(["text/plain"] * len(media)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


def features(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, declared, media_type) from stored media.

    media_type is the sniffed one, which corrects the declared one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type"]
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for v in batch.column("media"):
                m = v.as_py()
                payload, kind, inside = samples(m, a)
                x = np.frombuffer(payload, np.uint8)
                loud = int(np.abs(x.astype(np.int16) - 128).max())
                out["media_type"].append(kind)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-32:]))
                out["media_bytes"].append(len(m))
                out["media_sha256"].append(hashlib.sha256(m).hexdigest())
                out["feature"].append(f"{kind};frames={len(x)};mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};peak={loud};embedded={','.join(f'{k}@{s}+{n}' for k, s, n in inside)}")
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)), batch.column("declared")], names=["doc_id", "n_bytes", *names, "declared"])

    return media.select("doc_id", "n_bytes", "media", "declared").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, declared string")
