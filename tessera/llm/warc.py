"""WARC archives: a writer and a salvage reader.

Writer: a record per page, each a gzip member of its own, so that damage to one member leaves
the others whole. Of records with equal payloads of at least SMALL bytes the one with the
smallest page_id is a response; the others are revisit records that name it, have the
payload's digest and length and carry no payload. Records are gathered into archives of about
ARCHIVE bytes, kept as rows (archive, content) in a Parquet table in the shared folder, which
any executor can write and read; `read_files` reads plain .warc and .warc.gz files.

Salvage reader: a gzip member is checked by its sum and length, a record by its version line, header,
length, closing line ends and payload digest. When a check fails, the reader searches for the
next gzip magic or version line at which a whole valid record begins, goes on from there and
logs the bytes between as a quarantined gap with the first reason. Every byte of an archive is
in a record or in a gap. Within a member the same search goes over the unpacked bytes, also over what could be
unpacked of a member that is damaged or cut off: its whole records are recovered (with the member's damage as their
reason), and the gaps between them are logged by their place among the unpacked bytes. Headers have no greatest length.

Null html is an empty payload. A page with a null page_id is never chosen as the response of
others' revisits unless all are null; a null url is an empty target. Rows that share the
smallest page_id of their payload are all responses.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as C

SMALL, ARCHIVE = 100, 4 << 20
DATE = "2024-01-01T00:00:00Z"
#: What an unpacked member may have at most, as a value of a row holds no more; beyond it is taken for damage.
MOST_MEMBER = 1 << 31
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
END = b"\r\n\r\n"


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, size: int, refers: int | None) -> bytes:
    """One uncompressed record."""
    body = payload if kind == "response" else b""
    target = "".join(f"%{ord(c):02X}" if c <= " " else c for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if refers is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers}>")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + END + body + END


def gzipped(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Found:
    """A record, or with kind `gap` a stretch of quarantined bytes; inner, inner_n: its place among the unpacked bytes of the member at start."""

    start: int
    n: int
    kind: str
    reason: str | None = None
    fields: dict[str, str] | None = None
    payload: bytes = b""
    inner: int | None = None
    inner_n: int | None = None


class Damage(Exception):
    """Why no valid record begins here."""


class Records:
    """The uncompressed records of some bytes."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.endless = len(data) + 1  # from here on no header ends

    def at(self, at: int) -> tuple[Found, int]:
        """The record at `at`, and where it ends."""
        data = self.data
        if not VERSION.match(data, at):
            raise Damage("no version line")
        stop = data.find(END, at) if at < self.endless else -1
        if stop < 0:
            self.endless = min(self.endless, at)
            raise Damage("header without end")
        fields: dict[str, str] = {}
        last = ""
        for line in data[at:stop].split(b"\r\n")[1:]:
            text = line.decode("utf-8", "replace")
            if text[:1] in (" ", "\t") and last:
                fields[last] += " " + text.strip()
                continue
            name, colon, value = text.partition(":")
            if not colon:
                raise Damage("header line without a colon")
            last = name.strip().lower()
            fields[last] = value.strip()
        size = fields.get("content-length", "")
        if not size.isascii() or not size.isdigit() or len(size) > 18 or "warc-type" not in fields:
            raise Damage("no type or length")
        body = stop + 4
        end = body + int(size)
        if data[end : end + 4] != END:
            raise Damage("wrong length")
        payload = data[body:end]
        digest = fields.get("warc-payload-digest", "")
        if digest.startswith("sha256:") and fields["warc-type"] != "revisit" and hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise Damage("wrong digest")
        return Found(at, end + 4 - at, fields["warc-type"], None, fields, payload), end + 4

    def all(self) -> list[Found]:
        """Records and gaps in order; they cover the bytes."""
        out: list[Found] = []
        at, gap, why = 0, -1, ""
        while at < len(self.data):
            try:
                found, end = self.at(at)
            except Damage as e:
                if gap < 0:
                    gap, why = at, str(e)
                nxt = VERSION.search(self.data, at + 1)
                at = nxt.start() if nxt else len(self.data)
                continue
            if gap >= 0:
                out.append(Found(gap, at - gap, "gap", why))
                gap = -1
            out.append(found)
            at = end
        if gap >= 0:
            out.append(Found(gap, len(self.data) - gap, "gap", why))
        return out


def member_start(data: bytes, at: int) -> int:
    """Where the deflated bytes of the gzip member at `at` begin."""
    if at + 10 > len(data):
        raise Damage("member without end")
    flags, p = data[at + 3], at + 10
    if flags & 4:
        p += 2 + int.from_bytes(data[p : p + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            p = data.find(b"\0", p) + 1
            if not p:
                raise Damage("member without end")
    return p + 2 * (flags >> 1 & 1)


def member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What can be unpacked of the gzip member at `at`, where it ends (if damaged, from where on another can start), and its damage."""
    p = member_start(data, at)
    d = zlib.decompressobj(-15)
    out, total = [], 0
    while not d.eof:
        piece = data[p : p + 65536]
        if not piece:
            return b"".join(out), at + 1, "member without end"
        p += len(piece)
        while piece and not d.eof:
            before = d.copy()
            try:
                out.append(d.decompress(piece, 1 << 22))
            except zlib.error as e:
                # Once more byte by byte, for what comes before the damage.
                for k in range(len(piece)):
                    try:
                        out.append(before.decompress(piece[k : k + 1]))
                    except zlib.error:
                        break
                return b"".join(out), at + 1, f"member: {str(e)[:60]}"
            total += len(out[-1])
            if total > MOST_MEMBER:
                return b"".join(out), at + 1, "member too long"
            piece = d.unconsumed_tail
    inner, p = b"".join(out), p - len(d.unused_data)
    if data[p : p + 8] == zlib.crc32(inner).to_bytes(4, "little") + (len(inner) & 0xFFFFFFFF).to_bytes(4, "little"):
        return inner, p + 8, None
    return inner, p, "member: wrong sum" if p + 8 <= len(data) else "member without end"


def salvage(data: bytes) -> Iterator[Found]:
    """All records and gaps of an archive, in order; they cover it."""
    at, gap, why = 0, -1, ""
    plain = Records(data)
    while at < len(data):
        end = at + 1
        try:
            if data[at : at + 3] == b"\x1f\x8b\x08":
                inner, end, damage = member(data, at)
                if damage:
                    nxt = START.search(data, end)
                    end = nxt.start() if nxt else len(data)
                found = Records(inner).all()
                if all(f.kind == "gap" for f in found):
                    raise Damage(damage or (found[0].reason if found else "empty member"))
                if damage:
                    found.append(Found(len(inner), 0, "gap", damage))
                found = [Found(at, end - at, f.kind, f.reason or damage, f.fields, f.payload, f.start, f.n) for f in found]
            else:
                r, end = plain.at(at)
                found = [r]
        except Damage as e:
            if gap < 0:
                gap, why = at, str(e)
            if end == at + 1:
                nxt = START.search(data, end)
                end = nxt.start() if nxt else len(data)
            at = end
            continue
        if gap >= 0:
            yield Found(gap, at - gap, "gap", why)
            gap = -1
        yield from found
        at = end
    if gap >= 0:
        yield Found(gap, len(data) - gap, "gap", why)


def archived(pages: DataFrame) -> DataFrame:
    """(archive, content): pages (page_id, url, html) as archives, written to the shared folder."""
    C.small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.sha2("html", 256).alias("digest")
    slim = pages.where(F.octet_length("html") >= SMALL).select("page_id", digest)
    firsts = C.kept(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    marked = pages.withColumn("digest", digest).join(firsts, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")]
            for page, url, body, sha, first in zip(*cols, strict=True):
                again = first is not None and page != first
                held.append(gzipped(record("revisit" if again else "response", page, url, body, sha, len(body), first if again else None)))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return C.kept(marked.mapInArrow(run, "archive string, content binary"))


ROWS = "archive string, start long, n long, inner long, inner_n long, kind string, reason string, page_id long, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and gap of archives (archive, content): ROWS.

    inner and inner_n are null outside of gzip members; reason tells why a gap is one, or of a record that its member is damaged.
    payload_bytes and payload_digest are counted from the payload, but for revisits, which
    have them in their header. Repeated or overlapping archives are read as often as they stand there.
    """
    C.small_batches(archives.sparkSession)

    def number(text: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(m[1]) if m else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for f in salvage(content.as_py() or b""):
                    h = f.fields or {}
                    if f.kind == "gap":
                        n = sha = None
                    elif f.kind == "revisit":
                        n = int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
                        sha = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    else:
                        n, sha = len(f.payload), hashlib.sha256(f.payload).hexdigest()
                    rows.append((name, f.start, f.n, f.inner, f.inner_n, f.kind, f.reason, number(h.get("warc-record-id")), h.get("warc-target-uri"), number(h.get("warc-refers-to")), n, sha, f.payload if payloads and f.kind not in ("gap", "revisit") else None))
                    size += len(f.payload) * payloads
                    if len(rows) >= C.ROWS_A_BATCH or size >= C.SLICE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive", "content").mapInArrow(run, ROWS)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records and gaps of .warc and .warc.gz files (each of under 2 GB, as a row holds it)."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"), payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from the archives of pages."""
    rows = read(archived(pages), payloads=False).where("kind <> 'gap'")
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
