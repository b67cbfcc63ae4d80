"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 32 bytes, h = (h << 1) + word(byte), is taken for every
byte; where its top bits are zero a chunk may end. A chunk has at least LEAST bytes (but for
a text's last; its first, SEEN) and at most MOST. Ends depend on nearby bytes only, so after an insertion
chunks fall into step again.

Chunks are deduplicated by a 128-bit digest. A chunk is repeated if its digest occurs in
two places or more; the occurrence with the smallest (doc_id, start) stays and all others
go, however short: RUN is 1. A caller may ask for more, so that repeated chunks count only in
runs, side by side, of at least so many bytes.

A null text is empty and has no chunk. If a
row is repeated its chunks have the same place and so are one occurrence. A row with a null
doc_id, and one that isn't the document of its doc_id (common.keyed), is no document: it keeps its bytes and is nobody's other
place. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common as C

LEAST, AVERAGE_BITS, MOST, RUN = 16, 5, 256, 1
#: Bytes that the rolling hash sees; no chunk ends nearer to its text's start by the hash.
SEEN = 32
GEAR = (C.BYTE_WORD >> C.U(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling: the hash of 2k bytes is that of the last k plus the shifted hash of the k before."""
    h, k = GEAR[data], 1
    while k < SEEN and k < len(h):
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
        k *= 2
    return h


def ends(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, end) of each chunk, end as a place in data."""
    h = gear(data)
    cut = h >> np.uint32(32 - AVERAGE_BITS) == 0
    at = np.flatnonzero(cut)
    row = np.searchsorted(offs, at, "right") - 1
    good = at - offs[row] >= SEEN - 1  # so that it never sees the row before
    at, row = at[good] + 1, row[good]
    first = np.searchsorted(row, np.arange(len(offs)))
    at_list, rows, out = at.tolist(), [], []
    for i in range(len(offs) - 1):
        last, stop = int(offs[i]), int(offs[i + 1])
        for e in at_list[first[i] : first[i + 1]]:
            while e - last > MOST:
                last += MOST
                out.append(last)
                rows.append(i)
            if e - last >= LEAST:
                last = e
                out.append(e)
                rows.append(i)
        while stop - last > MOST:
            last += MOST
            out.append(last)
            rows.append(i)
        if stop > last:
            out.append(stop)
            rows.append(i)
    return np.array(rows, np.int64), np.array(out, np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n, hi, lo) of every chunk of docs (doc_id, text); hi and lo are its digest."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            row, end = ends(data, offs)
            start = np.concatenate(([0], end[:-1])) if len(end) else end
            raw = data.tobytes()
            digest = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True))
            pair = np.frombuffer(digest, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(row)), pa.array(start - offs[row]), pa.array((end - start).astype(np.int32)), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())],
                names=["doc_id", "start", "n", "hi", "lo"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null and doc_id is not null")
    return slim.mapInArrow(run, "doc_id long, start long, n int, hi long, lo long")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<start, n, first>>): repeated chunks by place; first marks the occurrence that stays."""
    every = chunks(docs)
    at = F.struct("doc_id", "start")
    met = C.kept(every.groupBy("hi", "lo").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("hi", "lo", "low"))
    found = every.join(met, ["hi", "lo"]).select("doc_id", F.struct("start", "n", (at == F.col("low")).alias("first")).alias("x"))
    return found.groupBy("doc_id").agg(F.collect_list("x").alias("spans"))


def joined_runs(start: np.ndarray, n: np.ndarray, first: np.ndarray, least: int) -> tuple[int, list[tuple[int, int]]]:
    """Chunks in runs of at least `least` bytes, and the ascending spans of them that go."""
    order = np.argsort(start, kind="stable")
    count, gone = 0, []
    held: list[tuple[int, int, bool]] = []

    def close() -> None:
        nonlocal count
        if held and held[-1][1] - held[0][0] >= least:
            count += len(held)
            for a, b, keep in held:
                if not keep:
                    if gone and gone[-1][1] == a:
                        gone[-1] = (gone[-1][0], b)
                    else:
                        gone.append((a, b))

    for a, k, keep in zip(start[order].tolist(), n[order].tolist(), first[order].tolist(), strict=True):
        if held and a == held[-1][0]:
            continue  # the same row again
        if held and a != held[-1][1]:
            close()
            held = []
        held.append((a, a + k, keep))
    close()
    return count, gone


def deduplicated(docs: DataFrame, least: int = RUN) -> DataFrame:
    """(doc_id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256, kept_text) of docs (doc_id, text).

    n_repeated: chunks that also stand elsewhere, in runs that count; n_removed: bytes of
    those that aren't the first occurrence; kept_text: the rest (bytes of a character that was
    cut through are dropped), null where nothing was removed.
    """
    docs = C.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "key")
    slim = docs.select("key", F.col("text").cast("binary").alias("text")).where("key is not null")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    with C.scope() as needed:
        found = needed(C.kept(spans(docs.select(F.col("key").alias("doc_id"), "text")).withColumnRenamed("doc_id", "key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            x = rows.column("spans")
            cut = np.concatenate(([0], np.cumsum(np.asarray(x.value_lengths()))))
            x = x.flatten()
            start, n, first = np.asarray(x.field(0)), np.asarray(x.field(1)), np.asarray(x.field(2).cast(pa.int8()))
            out: dict[str, list] = {k: [] for k in ("c", "r", "s", "h", "t")}
            for i in range(len(offs) - 1):
                raw = data[offs[i] : offs[i + 1]].tobytes()
                a, b = cut[i], cut[i + 1]
                count, gone = joined_runs(start[a:b], n[a:b], first[a:b], least)
                keep, at = [], 0
                for p, q in gone:
                    keep.append(raw[at:p])
                    at = q
                keep.append(raw[at:])
                rest = b"".join(keep)
                out["c"].append(count)
                out["r"].append(len(raw) - len(rest))
                out["s"].append(len(gone))
                out["h"].append(hashlib.sha256(rest).hexdigest())
                out["t"].append(rest.decode("utf-8", "ignore") if gone else None)
            yield pa.RecordBatch.from_arrays([rows.column("key"), *(pa.array(out[k], pa.int64()) for k in "crs"), pa.array(out["h"], pa.string()), pa.array(out["t"], pa.string())], names=["key", "n_repeated", "n_removed", "n_spans", "sha", "kept_text"])

    cut = slim.join(found, "key").mapInArrow(run, "key long, n_repeated long, n_removed long, n_spans long, sha string, kept_text string").dropDuplicates(["key"])
    own = docs.select("key", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_repeated", "n_removed", "n_spans")]
    return own.join(cut, "key", "left").select("doc_id", "n_bytes", *zero, F.coalesce("sha", "own").alias("kept_sha256"), "kept_text")
