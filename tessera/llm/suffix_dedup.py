"""Repeated substrings by a hash-compared suffix sort.

Every byte covered by a string of `length` bytes that also starts anywhere else is
removed; strings are judged on the input. Equal windows of that length must meet in one
sort, so they are dealt by content:

1. Anchors. In each window the k-gram with the smallest hash (leftmost on ties) is its
   anchor. Equal windows have equal anchors at equal distances, so a window whose anchor
   occurs once in the corpus is unique. Only anchors met twice or more go on. Texts that
   occur whole more than once are removed whole; one of them stands for all here.
2. Pieces. An anchor's run of windows is one stretch of bytes. Equal pieces collapse before the shuffle, with a
   count; a piece met twice is repeated as a whole. Which are equal is told by a cryptographic digest (BLAKE2b, 128 bits;
   SHA-256 for whole texts), which nobody can make two different strings agree in.
3. Sort. A task puts the different pieces of many anchors end to end, takes prefix polynomial hashes and sorts the
   suffixes that begin a window, by distance to the anchor, in a bottom-up mergesort. A
   comparison finds the common extension by binary search over prefix hashes, in 8 probes.
   Neighbours with an extension of at least `length` are compared byte by byte before
   their windows count as repeated.
4. An anchor with over FULL different pieces would outgrow a task. Its pieces are split into blocks of up to STEP
   windows at fixed distances from the anchor, and a block is dealt by a longer context: the inner stretch that all its windows
   share. Equal blocks collapse as pieces do and the different ones of an inner stretch are sorted. Where these are over FULL again,
   the context is the whole window: equal windows collapse and nothing is left to sort. So no task grows with the
   copies of a passage, or with the contexts it stands in.

A null text is empty. Texts shorter than `length` keep all bytes. Repeated rows are
copies of each other like any other rows with equal texts. A row with a null doc_id, and one that isn't the document of
its doc_id (common.keyed), is no document: it keeps its bytes and is nobody's other place.
Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .minhash import _groups

#: STEP is about the square root of a run's mean length, where blocks and single windows are as many.
LENGTH, GRAM, STEP = 200, 64, 8
#: Bytes of pieces that one sort holds, and the different pieces (each of under 2 * LENGTH bytes) that a group may bring to it.
BUNDLE, FULL = 1 << 20, 1024
PLACE = 24
SEGMENT = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbours, by doubling."""
    m, span = v, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    n = len(v) - w + 1
    return np.minimum(m[:n], m[w - span : w - span + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, hash, place, before, after): each anchor's row, and its place in it; its windows start from before to after bytes ahead of it."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = C.prefix_hashes(data)
    n = len(data) - gram + 1
    g = C.mix((h[gram:] - h[:n]) * C.powers(C.INVERSE, n))
    key = (g >> C.U(PLACE) << C.U(PLACE)) | np.arange(n, dtype=np.uint64)
    least = least_in_windows(key, length - gram + 1)
    ends = np.repeat(offs[1:], np.diff(offs))
    start = np.flatnonzero(ends[: len(least)] - np.arange(len(least)) >= length)
    at = (least[start] & C.U((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    p = at[first]
    row = np.searchsorted(offs, p, "right") - 1
    return row, g[p], p - offs[row], p - start[first], p - start[last[: len(first)]]


def in_segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of rows; a very long row comes in segments that overlap by a window less one byte."""
    for rows, data, offs in C.slices(batches):
        if len(data) <= SEGMENT:
            yield rows, data, offs, 0
            continue
        for a in range(0, len(data), SEGMENT):
            x = data[a : a + SEGMENT + length - 1]
            yield rows, x, np.array([0, len(x)]), a


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc_id, at) of each anchor; at packs its place and the run of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs, base in in_segments(batches, length):
            row, h, p, a, b = anchors(data, offs, length, gram)
            ids = rows.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array((p + base) << 16 | a << 8 | b)], names=["h", "doc_id", "at"])

    return docs.mapInArrow(run, "h long, doc_id long, at long")


class Suffixes:
    """Suffixes of one text compared by prefix hashes, up to a depth."""

    def __init__(self, data: np.ndarray, depth: int) -> None:
        self.data, self.depth = data, depth
        self.same = C.Prefixes(data).same

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The common extension of the suffixes at x and at y, at most depth, by binary search."""
        out = np.full(len(x), self.depth)
        rest = np.flatnonzero(~self.same(x, y, self.depth))
        if len(rest):
            x, y = x[rest], y[rest]
            lo, hi = np.zeros(len(x), np.int64), np.full(len(x), self.depth)
            for _ in range(int(self.depth).bit_length()):
                mid = (lo + hi) // 2
                ok = self.same(x, y, mid)
                lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
            out[rest] = lo
        return out

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at x is less than, equal to or greater than that at y, up to depth."""
        n = self.common(x, y)
        at = np.minimum(n, self.depth - 1)
        a, b = self.data[x + at].astype(np.int16), self.data[y + at].astype(np.int16)
        return np.where(n >= self.depth, 0, np.sign(a - b))

    def sorted(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """An order of the suffixes at start, grouped by group (which ascends), by mergesort within each."""
        order = np.arange(len(start))
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((first, [len(start)])))
        use = np.repeat(size > 1, size)
        base, total = np.repeat(first, size)[use], np.repeat(size, size)[use]
        at = np.flatnonzero(use)
        run = 1
        while len(at):
            i = at - base
            block = i // (2 * run) * (2 * run)
            left = i - block < run
            lo = base + np.where(left, np.minimum(block + run, total), block)
            hi = base + np.where(left, np.minimum(block + 2 * run, total), np.minimum(block + run, total))
            low = lo.copy()
            mine = start[order[at]]
            go = np.flatnonzero(lo < hi)
            while len(go):
                mid = (lo[go] + hi[go]) // 2
                c = self.before(start[order[mid]], mine[go])
                less = np.where(left[go], c < 0, c <= 0)
                lo[go] = np.where(less, mid + 1, lo[go])
                hi[go] = np.where(less, hi[go], mid)
                go = go[lo[go] < hi[go]]
            put = base + block + np.where(left, i - block, i - block - run) + lo - low
            moved = order[at]
            order = order.copy()
            order[put] = moved
            run *= 2
            more = total > run
            at, base, total = at[more], base[more], total[more]
        return order


def equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Whether n bytes from x and from y are equal, eight at a time."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.ones(len(x), bool)
    step = [*range(0, n - 7, 8), n - 8] if n >= 8 else []
    whole = np.ascontiguousarray(words).view(np.uint64).ravel()
    for k in step:
        out &= whole[x + k] == whole[y + k]
    for k in range(n if n < 8 else 0):
        out &= data[x + k] == data[y + k]
    return out


def repeated(data: np.ndarray, offs: np.ndarray, group: np.ndarray, ahead: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of the pieces are repeated, as one flag for each window in piece order.

    data, offs: the pieces end to end; group: each piece's group; ahead: how far its first window starts ahead of its anchor.
    """
    count = np.diff(offs) - length + 1
    piece = np.repeat(np.arange(len(count)), count)
    k = np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    start = offs[piece] + k
    key = group[piece] * (1 << 9) + (ahead[piece] - k)
    by = np.argsort(key, kind="stable")
    s = Suffixes(data, length)
    order = by[s.sorted(start[by], key[by])]
    x, y = order[:-1], order[1:]
    near = np.flatnonzero(key[x] == key[y])
    x, y = x[near], y[near]
    near = np.flatnonzero(s.same(start[x], start[y], length))
    x, y = x[near], y[near]
    near = equal_bytes(data, start[x], start[y], length)
    out = np.zeros(len(piece), bool)
    out[x[near]] = True
    out[y[near]] = True
    return out


def runs(flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true flags of one owner."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])
    first = np.flatnonzero(new)
    return on[first], on[np.concatenate((first[1:], [len(on)])) - 1]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 ... count[0] of them, then those of start[1] ..."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum())) if len(count) else np.zeros(0, np.int64)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a cryptographic digest of each raw[start:end] with its salt."""
    blake, out = hashlib.blake2b, []
    for a, b, s in zip(start.tolist(), end.tolist(), salt.tolist(), strict=True):
        out.append(blake(raw[a:b], digest_size=16, salt=s.to_bytes(8, "little", signed=True)).digest())
    pair = np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)
    return pair[:, 0].copy(), pair[:, 1].copy()


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, twice): an index of each different key, and the indices of all whose key is met twice or more."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    lot = np.cumsum(new) - 1
    return order[new], order[np.bincount(lot)[lot] > 1] if len(order) else order


#: route is the group that is sorted together, d1 and d2 tell equal pieces of it; a row without a piece is a span known to be repeated.
PIECES = "route long, d1 long, d2 long, doc_id long, place long, n int, ahead int, piece binary"


def _batch(route: np.ndarray, d1: np.ndarray, d2: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, ahead: np.ndarray, piece: pa.Array) -> pa.RecordBatch:
    cols = [pa.array(route), pa.array(d1), pa.array(d2), pa.array(doc), pa.array(place), pa.array(n.astype(np.int32)), pa.array(ahead.astype(np.int32)), piece]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")])


def _spans(doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    return _batch(none, none, none, doc, place, n, none, pa.nulls(len(doc), pa.binary()))


def pieces(candidates: DataFrame, length: int) -> DataFrame:
    """PIECES of documents with candidate anchors. Of pieces that are equal within a slice of a document one goes on, and all are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            ids = np.asarray(rows.column("doc_id"))
            marks = rows.column("marks")
            row = np.repeat(np.arange(len(ids)), np.asarray(marks.value_lengths().fill_null(0)))
            marks = marks.flatten()
            at, n, g = (np.asarray(marks.field(k)) for k in range(3))
            use = n > np.asarray(rows.column("copies"))[row]  # else only copies of the whole text have this anchor
            at, g, row = at[use], g[use], row[use]
            p, a, b = at >> 16, at >> 8 & 255, at & 255
            first = p - a + offs[row]
            end = first + a - b + length
            d1, d2 = digests(data.tobytes(), first, end, g ^ a)
            one, twice = _first_of(row, g, d1, d2)
            for x in (one[k : k + (1 << 13)] for k in range(0, len(one), 1 << 13)):
                lens = end[x] - first[x]
                piece = C.binaries(data[ranges(first[x], lens)], np.concatenate(([0], np.cumsum(lens))))
                yield _batch(g[x], d1[x], d2[x], ids[row[x]], first[x] - offs[row[x]], lens, a[x], piece)
            if len(twice):
                yield _spans(ids[row[twice]], first[twice] - offs[row[twice]], end[twice] - first[twice])

    return candidates.mapInArrow(run, PIECES)


def blocks(large: DataFrame, length: int) -> DataFrame:
    """PIECES of up to STEP windows from those of anchors with too many; route is the anchor with the inner stretch of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches, "piece"):
            ids, place, ahead, g = (np.asarray(rows.column(c)) for c in ("doc_id", "place", "ahead", "route"))
            count = np.diff(offs) - length + 1
            owner = np.repeat(np.arange(len(count)), count)
            start = ranges(offs[:-1], count)
            far = ahead[owner] - (start - offs[owner])  # how far a window starts ahead of the anchor
            q = far // STEP
            new = np.ones(len(q), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (q[1:] != q[:-1])
            lo = np.flatnonzero(new)
            hi = np.concatenate((lo[1:], [len(q)])) - 1
            who = owner[lo]
            x, y = start[lo], start[hi] + length
            inner = x + far[lo] - q[lo] * STEP
            raw = data.tobytes()
            route, _ = digests(raw, inner, inner + length - STEP + 1, g[who] ^ q[lo] << 32)
            d1, d2 = digests(raw, x, y, g[who] ^ far[lo])
            lens = y - x
            piece = C.binaries(data[ranges(x, lens)], np.concatenate(([0], np.cumsum(lens))))
            yield _batch(route, d1, d2, ids[who], place[who] + x - offs[who], lens, far[lo], piece)

    return large.mapInArrow(run, PIECES)


def windows(large: DataFrame, length: int) -> DataFrame:
    """PIECES of one window each, without bytes, from those of inner stretches with too many; equal windows have equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches, "piece"):
            ids, place, ahead = (np.asarray(rows.column(c)) for c in ("doc_id", "place", "ahead"))
            count = np.diff(offs) - length + 1
            owner = np.repeat(np.arange(len(count)), count)
            start = ranges(offs[:-1], count)
            k = start - offs[owner]
            d1, d2 = digests(data.tobytes(), start, start + length, np.zeros(len(start), np.int64))
            yield _batch(d1, d1, d2, ids[owner], place[owner] + k, np.full(len(k), length), ahead[owner] - k, pa.nulls(len(k), pa.binary()))

    return large.mapInArrow(run, PIECES)


KEY = ["route", "d1", "d2"]


def _different(found: DataFrame) -> DataFrame:
    """Each different piece once, as it stands in one place, and k, how often it was met."""
    one = F.any_value(F.struct("doc_id", "place", "n", "ahead", "piece")).alias("one")
    return C.kept(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), one).select(*KEY, "k", "one.*"))


def _copied(found: DataFrame, different: DataFrame) -> DataFrame:
    """(doc_id, place, n): the places of pieces met twice or more."""
    met = C.kept(different.where("k > 1").select(*KEY))
    return found.select(*KEY, "doc_id", "place", "n").join(met, KEY).select("doc_id", "place", F.col("n").cast("long").alias("n"))


def _by_size(different: DataFrame, full: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of groups that one sort can hold, and of the others."""
    large = C.kept(different.groupBy("route").agg(F.count(F.lit(1)).alias("group")).where(F.col("group") > full).select("route"))
    return different.join(large, "route", "left_anti"), different.join(large, "route", "left_semi")


def sorted_spans(found: DataFrame, length: int) -> DataFrame:
    """(doc_id, place, n): spans of repeated windows among pieces dealt by route."""

    def bundle(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        data, offs = C.flat(t.column("piece"))
        group = np.repeat(np.arange(len(tables)), [len(x) for x in tables])
        flag = repeated(data, offs, group, np.asarray(t.column("ahead")).astype(np.int64), length)
        count = np.diff(offs) - length + 1
        owner = np.repeat(np.arange(len(count)), count)
        base = np.concatenate(([0], np.cumsum(count)[:-1]))
        x, y = runs(flag, owner)
        place = np.asarray(t.column("place"))[owner[x]] + x - base[owner[x]]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(t.column("doc_id"))[owner[x]]), pa.array(place), pa.array(y - x + length)], names=["doc_id", "place", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in _groups(batches, ("route",)):
            if len(t) < 2:
                continue
            held.append(t)
            size += t.nbytes
            if size >= BUNDLE:
                yield bundle(held)
                held, size = [], 0
        if held:
            yield bundle(held)

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("route", "doc_id", "place", "ahead", "piece").repartition(n, "route").sortWithinPartitions("route", "doc_id", "place")
    return dealt.mapInArrow(run, "doc_id long, place long, n long")


def merged(start: np.ndarray, n: np.ndarray) -> list[tuple[int, int]]:
    """The union of the spans as ascending disjoint (start, end); touching ones become one."""
    order = np.argsort(start, kind="stable")
    out: list[tuple[int, int]] = []
    for a, b in zip(start[order].tolist(), (start + n)[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(found: DataFrame, length: int, full: int) -> DataFrame:
    """(doc_id, place, n) of all repeated windows among pieces, some more than once."""
    out = found.where("piece is null").select("doc_id", "place", F.col("n").cast("long").alias("n"))
    found = found.where("piece is not null")
    for finer in (blocks, windows, None):
        different = _different(found)
        out = out.unionByName(_copied(found, different))
        if finer is None:
            return out
        small, large = _by_size(different, full)
        out = out.unionByName(sorted_spans(small, length))
        if large.isEmpty():
            return out
        found = C.kept(finer(large, length))
    return out


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, full: int = FULL) -> tuple[DataFrame, DataFrame]:
    """(whole, part): doc_id of texts that occur more than once and are removed whole; and doc_id, text (binary) and spans (place, n) of the others with a repeat."""
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull())
    slim = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"))
    met = C.kept(slim.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    # Counts are written before they are joined, so that the join has two plain exchanges, whose skewed partitions Spark splits.
    whole = C.kept(slim.join(met, "digest").select("doc_id", "rep", "copies"))
    every = C.kept(anchored(docs, length, gram))
    common = C.kept(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    marks = every.join(common, "h").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "h")).alias("marks"))
    marks = marks.join(whole, "doc_id", "left").where("rep is null or rep = doc_id").select("doc_id", "marks", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    candidates = C.kept(docs.join(marks, "doc_id"))
    all_spans = spans(C.kept(pieces(candidates, length)), length, full).groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("spans"))
    part = candidates.where("copies = 1").select("doc_id", "text").join(all_spans, "doc_id")
    return whole.select("doc_id"), part


def cuts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False, full: int = FULL) -> DataFrame:
    """(doc_id, took, count, sha, kept_text) of the documents that lose bytes; took is -1 where all go."""
    whole, part = repeats(docs, length, gram, full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            spans = rows.column("spans")
            cut = np.concatenate(([0], np.cumsum(np.asarray(spans.value_lengths()))))
            spans = spans.flatten()
            place, n = np.asarray(spans.field(0)), np.asarray(spans.field(1))
            took, count, sha, rest = [], [], [], []
            for i in range(len(offs) - 1):
                text = data[offs[i] : offs[i + 1]].tobytes()
                gone = merged(place[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]])
                keep, at = [], 0
                for a, b in gone:
                    keep.append(text[at:a])
                    at = b
                keep.append(text[at:])
                keep = b"".join(keep)
                took.append(len(text) - len(keep))
                count.append(len(gone))
                sha.append(hashlib.sha256(keep).hexdigest())
                rest.append(keep.decode("utf-8", "ignore") if texts else None)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(took, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.string())], names=["doc_id", "took", "count", "sha", "kept_text"])

    cut = part.mapInArrow(run, "doc_id long, took long, count long, sha string, kept_text string")
    gone = whole.select("doc_id", F.lit(-1).cast("long").alias("took"), F.lit(1).cast("long").alias("count"), F.lit(EMPTY).alias("sha"), F.lit("").alias("kept_text"))
    return cut.unionByName(gone).dropDuplicates(["doc_id"])


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, full: int = FULL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs (doc_id, text)."""
    docs = C.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "key")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    out = docs.select("key", F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"))
    with C.scope() as needed:
        found = needed(C.kept(cuts(docs.select(F.col("key").alias("doc_id"), "text"), length, gram, full=full).select(F.col("doc_id").alias("key"), "took", "count", "sha")))
    out = out.join(found, "key", "left")
    took = F.when(F.col("took") == -1, F.col("n_bytes")).otherwise(F.coalesce("took", F.lit(0)))
    return out.select("doc_id", "n_bytes", took.alias("n_removed"), F.coalesce("count", F.lit(0)).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes out of text (bytes of a character that was cut through go too)."""
    key = f"_{uuid.uuid4().hex}"
    docs = C.keyed(docs, key)
    with C.scope() as needed:
        new = needed(C.kept(cuts(docs.select(F.col(key).alias("doc_id"), "text"), length, gram, texts=True).select("doc_id", F.col("kept_text").alias("text"))))
    return C.replaced(docs, key, new)
