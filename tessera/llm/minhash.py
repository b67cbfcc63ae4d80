"""MinHash near-duplicates with b-bit signatures.

Five-word shingles of whole texts; documents are linked when 100 * intersection is at
least `percent` * union. One pass makes per document its shingle count, a digest of its
sorted shingle set, bands of full minima and a b-bit signature. Then:

1. Documents with the same words in the same order (SHA-256) collapse to their smallest doc_id.
2. Band keys met by two documents or more are candidate buckets. Within a bucket of at most BLOCK,
   packed signatures are compared by bit counts; the estimate,
   corrected for chance agreement of b bits, is held against a cut six standard
   deviations below the threshold. A spanning forest of what passes makes coarse groups:
   supersets of the linked components. The members of a larger bucket are one group without a comparison here.
3. Within blocks of coarse groups, signatures are compared so too, and where an estimate passes, the link is
   confirmed on full sets: words are numbered by their bytes, so that no hash decides.
4. Groups of more than one block then compare the documents outside their largest class with those of other blocks that
   share a shingle of the prefix with them: of n shingles, by rising frequency in a few documents of the group, the first n - ceil(n * percent / 100) + 1,
   one of which every linked pair has in common. So a common template brings no pairs together, no link is lost
   and no task holds a group; pairs are looked at by lots of LOT blocks and blocks, whatever the group's size.

A pair at exactly `percent` shares no band with probability MISS at most: at 85 there are
32 bands of 6 minima (3e-7), at 80 there are 38 of 5 (3e-7).

Nulls, empty texts and texts without a word have an empty set and are linked with
nothing. Repeated rows count as one document and are all returned. A row with a null doc_id, and one that isn't the document of
its doc_id (common.keyed), is linked with nothing: without a doc_id it has no component and is not kept, otherwise
it has its own. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common as C

WORD = np.ones(256, bool)
WORD[[0x20, 9, 10, 11, 12, 13]] = False
WORDS, PERCENT = 5, 85
MINIMA, BITS, MISS = 192, 2, 1e-6
BLOCK, LOT, SAMPLE = 128, 4, 16
_r = np.random.Generator(np.random.PCG64(7))
MULTIPLY = _r.integers(1 << 62, size=MINIMA, dtype=np.uint64) * C.U(2) + C.U(1)
ADD = _r.integers(1 << 63, size=MINIMA, dtype=np.uint64)


def word_numbers(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of each word; two words have one number if they have the same bytes."""
    start, end = C.word_spans(data, offs, WORD)
    h = C.Prefixes(data).spans(start, end)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if not C.equal_spans(data, start, end - start, data, start[first[number]], (end - start)[first[number]]).all():
        seen: dict[bytes, int] = {}
        number = np.array([seen.setdefault(data[x:y].tobytes(), len(seen)) for x, y in zip(start.tolist(), end.tolist(), strict=True)])
    return np.searchsorted(offs, start, "right") - 1, number.astype(np.int64)


def _windows(row: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first word, width) of the shingles of n rows, from the row of each word."""
    per = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(per)))
    count = np.where(per > 0, np.maximum(per - words + 1, 1), 0)
    base = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(n), count)
    return owner, np.arange(int(count.sum())) - base[owner] + first[owner], np.minimum(per, words)[owner]


def _distinct(s: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's different values in order, end to end, and their n + 1 offsets."""
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n))))


def exact_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The set of shingles of each row, as numbers that are the same for the same words; data has lower case."""
    n = len(offs) - 1
    row, number = word_numbers(data, offs)
    owner, at, width = _windows(row, n, words)
    s = np.zeros(len(owner), np.int64)
    for k in range(words):
        word = np.where(k < width, number[np.minimum(at + k, len(number) - 1)] + 1, 0) if len(owner) else s
        _, s = np.unique(s * (int(number.max(initial=0)) + 2) + word, return_inverse=True)
    s, so = _distinct(s, owner, n)
    return [s[a:b] for a, b in zip(so[:-1].tolist(), so[1:].tolist(), strict=True)]


def shingles(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their n + 1 offsets."""
    data = C.LOWER[data]
    start, end = C.word_spans(data, offs, WORD)
    h = C.Prefixes(data).spans(start, end)
    n = len(offs) - 1
    owner, at, width = _windows(np.searchsorted(offs, start, "right") - 1, n, words)
    s = width.astype(np.uint64) * C.U(0x9E3779B97F4A7C15)
    for k in range(words):
        x = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else s
        s = np.where(k < width, C.mix(s + x), s)
    return _distinct(s, owner, n)


def plain(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case words of each row with one space between them, and the offsets of the rows."""
    data = C.LOWER[data]
    start, _ = C.word_spans(data, offs, WORD)
    row = np.searchsorted(offs, start, "right") - 1
    gap = start[1:][row[1:] == row[:-1]] - 1
    keep = WORD[data]
    keep[gap] = True
    data[gap] = 0x20
    return data[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def minima(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows with shingles, MINIMA): the least of each hash over each row's shingles."""
    start = offs[:-1][np.diff(offs) > 0]
    out = np.empty((MINIMA, len(start)), np.uint64)
    for m in range(MINIMA):
        x = s * MULTIPLY[m]
        x += ADD[m]
        out[m] = np.minimum.reduceat(x, start) if len(start) else 0
    return np.ascontiguousarray(out.T)


def packed(least: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The middle bits of each minimum as bit planes: (rows, bits, MINIMA / 64) words.

    A minimum over many values starts with zeros, so bits well below the top are kept,
    after mixing, as the low bits of b-bit MinHash.
    """
    low = C.mix(least.copy())
    out = np.empty((len(least), bits, MINIMA // 64), np.uint64)
    weight = C.U(1) << np.arange(64, dtype=np.uint64)
    for b in range(bits):
        plane = (low >> C.U(b)) & C.U(1)
        out[:, b] = (plane.reshape(len(least), MINIMA // 64, 64) * weight).sum(2, dtype=np.uint64)
    return out


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of each of one with each of many."""
    bits = one.shape[1]
    differ = one[:, None, 0] ^ many[None, :, 0]
    for b in range(1, bits):
        differ = differ | (one[:, None, b] ^ many[None, :, b])
    same = 1 - np.bitwise_count(differ).sum(2) / MINIMA
    chance = 0.5**bits
    return (same - chance) / (1 - chance)


def cut(percent: int, bits: int = BITS) -> float:
    """Six standard deviations below percent for an estimate from MINIMA minima."""
    chance = 0.5**bits
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - 6 * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def banding(percent: int) -> tuple[int, int]:
    """(bands, minima in each): the widest bands by which a pair at exactly percent is missed with probability MISS at most."""
    for rows in range(MINIMA, 1, -1):
        if (1 - (percent / 100) ** rows) ** (MINIMA // rows) <= MISS:
            return MINIMA // rows, rows
    return MINIMA, 1


SIGNED = "doc_id long, key long, n_shingles long, digest binary, sig binary, bands array<long>"


def signed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Shingle count, digest of the words, signature and band keys of each row of docs (doc_id, key, text)."""
    C.small_batches(docs.sparkSession)
    bands, width = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            s, so = shingles(data, offs)
            n = np.diff(so)
            have = np.flatnonzero(n)
            least = minima(s, so)
            wide = MINIMA * BITS // 8
            sig = packed(least).view(np.uint8).reshape(len(have), wide)
            keys = np.zeros((len(have), bands), np.uint64)
            for r in range(width):
                keys = C.mix(keys * C.U(0x9E3779B97F4A7C15) + least[:, r : bands * width : width] + C.U(r + 1))
            keys = C.mix(keys + np.arange(bands, dtype=np.uint64))
            words, wo = plain(data, offs)
            raw = words.tobytes()
            digest = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True)]
            signature = np.zeros((len(n), wide), np.uint8)
            signature[have] = sig
            full = np.where(n > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), C.binaries(signature.ravel(), np.arange(len(n) + 1) * wide),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full))), pa.int32()), pa.array(keys.view(np.int64).ravel())),
                ],
                names=["doc_id", "key", "n_shingles", "digest", "sig", "bands"],
            )

    return docs.select("doc_id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows with the same keys, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Classes:
    """Union-find over 0 .. n - 1 that keeps the smallest root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _signatures(col: pa.ChunkedArray) -> np.ndarray:
    data, offs = C.flat(col)
    return data.reshape(len(offs) - 1, -1).view(np.uint64).reshape(len(offs) - 1, BITS, -1)


def coarse(buckets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the pairs of a bucket whose estimate passes the cut."""
    least = cut(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("key",)):
            ids = np.asarray(t.column("doc_id"))
            if len(ids) < 2:
                continue
            sig = _signatures(t.column("sig"))
            sets = Classes(len(ids))
            for a in range(0, len(ids), 512):
                for b in range(0, a + 1, 512):
                    x, y = np.nonzero(estimates(sig[a : a + 512], sig[b : b + 512]) >= least)
                    for i, j in zip((x + a).tolist(), (y + b).tolist(), strict=True):
                        if i > j:
                            sets.join(i, j)
            root = np.array([sets.root(i) for i in range(len(ids))])
            use = root != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(ids[root[use]])], names=["a", "b"])

    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.repartition(n, "key").sortWithinPartitions("key", "doc_id")
    return dealt.mapInArrow(run, "a long, b long")


def shared(one: list[np.ndarray], many: list[np.ndarray], width: int = 1 << 13) -> np.ndarray:
    """Sizes of the intersections of each set of one with each set of many, exactly.

    Shingles get numbers; sets become 0/1 rows over a stretch of the numbers at a time,
    and a product of such rows counts what is common (exact in float32: below 2**24 a stretch).
    """
    out = np.zeros((len(one), len(many)), np.int64)
    if not one or not many:
        return out
    a, b = np.concatenate(one), np.concatenate(many)
    both = np.intersect1d(a, b)
    if not len(both):
        return out
    ra, rb = np.repeat(np.arange(len(one)), [len(x) for x in one]), np.repeat(np.arange(len(many)), [len(x) for x in many])

    def placed(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        hit = both[at] == v
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], r[hit][order]

    (pa_, ra), (pb, rb) = placed(a, ra), placed(b, rb)
    for lo in range(0, len(both), width):
        hi = min(lo + width, len(both))
        x, y = np.zeros((len(one), hi - lo), np.float32), np.zeros((len(many), hi - lo), np.float32)
        i, j = np.searchsorted(pa_, [lo, hi])
        x[ra[i:j], pa_[i:j] - lo] = 1
        i, j = np.searchsorted(pb, [lo, hi])
        y[rb[i:j], pb[i:j] - lo] = 1
        out += (x @ y.T).astype(np.int64)
    return out


def linked(one: list[np.ndarray], many: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for each pair."""
    both = shared(one, many)
    sizes = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in many])[None, :]
    return 100 * both >= percent * (sizes - both)


def confirmed(units: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) from units of rows (unit, part, doc_id, class, sig, words) with confirmed links.

    part 0 rows of a unit are compared with each other where the unit has no part 1
    rows, else with those; pairs of one class are skipped. The edges span what is linked.
    """
    least = cut(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("unit",)):
            ids, part, cls = (np.asarray(t.column(c)) for c in ("doc_id", "part", "class"))
            rows = np.flatnonzero(part == 0)
            cols = np.flatnonzero(part == 1) if (part == 1).any() else rows
            sig = _signatures(t.column("sig"))
            near = (estimates(sig[rows], sig[cols]) >= least) & (cls[rows][:, None] != cls[cols][None, :])
            rows, cols, near = rows[near.any(1)], cols[near.any(0)], near[near.any(1)][:, near.any(0)]
            if not near.size:
                continue
            use = np.union1d(rows, cols)
            sets = dict(zip(use.tolist(), exact_sets(*C.flat(t.column("words").take(pa.array(use)))), strict=True))
            found = Classes(len(ids))
            _, first, lot = np.unique(cls, return_index=True, return_inverse=True)
            for i, k in enumerate(first[lot].tolist()):
                found.join(k, i)
            x, y = np.nonzero(near & linked([sets[i] for i in rows.tolist()], [sets[i] for i in cols.tolist()], percent))
            edges = []
            for i, j in zip(rows[x].tolist(), cols[y].tolist(), strict=True):
                if found.root(i) != found.root(j):
                    found.join(i, j)
                    edges.append((i, j))
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], names=["a", "b"])

    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "unit").sortWithinPartitions("unit", "part", "doc_id").mapInArrow(run, "a long, b long")


def _by_slices(docs: DataFrame, name: str, kind: str, made: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """docs with what is made of text instead of it."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), made(data, offs)], names=[*rest, name])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rest) + f", {name} {kind}")


def worded(docs: DataFrame) -> DataFrame:
    """The words of each row, beside its other columns but text."""
    return _by_slices(docs, "words", "binary", lambda data, offs: C.binaries(*plain(data, offs)))


def _hash_lists(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    s, so = shingles(data, offs)
    return pa.ListArray.from_arrays(pa.array(so, pa.int32()), pa.array(s.view(np.int64)))


def prefixes(large: DataFrame, percent: int) -> DataFrame:
    """(component, doc_id, s): the first shingles of each row of large (component, doc_id, words), those rare in the component before others.

    Any order that is the same for all documents of a component loses no pair. How rare a shingle is is told by at most SAMPLE
    documents of the component: it is ordered by how many of them have it.
    """
    pick = F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64(F.lit(2), "doc_id"), "doc_id"))
    some = large.select("component", "doc_id", F.col("words").alias("text")).withColumn("k", pick).where(F.col("k") <= SAMPLE).drop("k")
    often = _by_slices(some, "s", "array<long>", _hash_lists).select("component", F.explode("s").alias("s")).groupBy("component", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A row has the shingles of SAMPLE documents at most.
    often = C.kept(often.groupBy("component").agg(F.collect_list(F.struct("s", "n")).alias("often")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in C.slices(batches):
            s, so = shingles(data, offs)
            lists = rows.column("often")
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            out = []
            for i, component in enumerate(rows.column("component").to_pylist()):
                if component not in known:
                    x = lists.slice(i, 1).flatten()
                    h, n = np.asarray(x.field(0)).view(np.uint64), np.asarray(x.field(1))
                    order = np.argsort(h)
                    known[component] = h[order], n[order]
                h, n = known[component]
                mine = s[so[i] : so[i + 1]]
                at = np.minimum(np.searchsorted(h, mine), max(len(h) - 1, 0))
                rank = np.where(h[at] == mine, n[at], 0) if len(h) else np.zeros(len(mine), np.int64)
                most = len(mine) - -(-len(mine) * percent // 100) + 1
                out.append(mine[np.lexsort((mine, rank))[:most]].view(np.int64))
            yield pa.RecordBatch.from_arrays([rows.column("component"), rows.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["component", "doc_id", "s"])

    each = large.select("component", "doc_id", F.col("words").alias("text")).join(often, "component", "left")
    each = each.select("component", "doc_id", "text", F.coalesce("often", F.array().cast("array<struct<s: bigint, n: bigint>>")).alias("often"))
    return each.mapInArrow(run, "component long, doc_id long, s array<long>").select("component", "doc_id", F.explode("s").alias("s"))


def across(large: DataFrame, percent: int) -> DataFrame:
    """Units of a lot of strays, the documents outside the largest class of their component in LOT blocks, and those of a block.

    A lot meets its own blocks and those that share a prefix shingle with it, and only documents that share one with
    another block go there. large: (doc_id, component, n, block, class, sig, words) of components of more than one block.
    """
    held = large.groupBy("component", "class").agg(F.count(F.lit(1)).alias("m"))
    main = held.groupBy("component").agg(F.max_by("class", F.struct("m", "class")).alias("main"), (F.sum("m") - F.max("m")).alias("strays"))
    main = C.kept(main.where("strays > 0").drop("strays"))
    own = F.floor(F.col("block") / LOT)
    large = C.kept(large.join(main, "component").withColumn("lot", F.when(F.col("class") != F.col("main"), own)).drop("main"))
    rare = C.kept(prefixes(large, percent).join(large.select("doc_id", "block", "lot"), "doc_id"))
    # Shingles that a stray shares with another block; then the documents that have one.
    met = rare.groupBy("component", "s").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.max("lot").alias("stray")).where("low <> high and stray is not null")
    met = C.kept(rare.join(C.kept(met.select("component", "s")), ["component", "s"], "left_semi"))
    lots = met.where("lot is not null").select("component", "s", "lot").distinct()
    pairs = met.select("component", "s", "block").distinct().join(lots, ["component", "s"]).where(own != F.col("lot")).select("component", "block", "lot")
    docs = C.kept(met.select("component", "block", "lot", "doc_id").distinct())
    near = docs.where("lot is not null").select("component", "lot").distinct().join(docs.select("component", own.alias("lot"), "block").distinct(), ["component", "lot"]).select("component", "block", "lot")
    pairs = C.kept(pairs.unionByName(near).distinct())
    here = docs.drop("lot").join(pairs, ["component", "block"]).select("component", "block", "lot", "doc_id", F.lit(1).alias("part"))
    there = docs.where("lot is not null").withColumnRenamed("block", "home").join(pairs, ["component", "lot"]).where("block <> home").select("component", "block", "lot", "doc_id", F.lit(0).alias("part"))
    shape = large.select("doc_id", "class", "sig", "words")
    return here.unionByName(there).join(shape, "doc_id").select(F.xxhash64("component", "block", "lot").alias("unit"), "part", "doc_id", "class", "sig", "words")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = C.keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "key")
    with C.scope() as needed:
        every = needed(C.kept(signed(docs, percent)))
        full = every.where("n_shingles > 0 and key is not null").select(F.col("key").alias("doc_id"), "digest", "sig", "bands")
        reps = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
        alone = full.join(reps, ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id"])
        banded = alone.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", "key")
        crowded = C.kept(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1"))
        met = C.kept(banded.join(crowded, "key"))
        tied = met.where(f"n > {BLOCK}").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
        sigs = full.select("doc_id", "sig").join(met.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        buckets = met.where(f"n <= {BLOCK}").select("doc_id", "key").join(sigs, "doc_id")
        groups = C.kept(C.components(coarse(buckets, percent).unionByName(tied)).withColumnRenamed("id", "doc_id"))
        # Written, so that joins on a component have plain exchanges, whose skewed partitions Spark splits.
        sizes = C.kept(groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(f"n > {BLOCK}"))
        groups = groups.join(sizes, "component", "left").select("doc_id", "component", F.coalesce("n", F.lit(1)).alias("n"))
        block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)).alias("block")
        texts = docs.select(F.col("key").alias("doc_id"), "text").join(groups, "doc_id").dropDuplicates(["doc_id"])
        sets = C.kept(worded(texts.join(sigs, "doc_id").select("doc_id", "component", "n", block, "sig", F.col("text").cast("binary").alias("text"))))
        inside = confirmed(sets.select(F.xxhash64("component", "block").alias("unit"), F.lit(0).alias("part"), "doc_id", F.col("doc_id").alias("class"), "sig", "words"), percent)
        links = C.kept(inside)
        if not sizes.isEmpty():
            classes = C.components(links).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "class")
            large = C.kept(sets.where(f"n > {BLOCK}").join(classes, "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id")))
            links = links.unionByName(C.kept(confirmed(across(large, percent), percent)))
        found = C.components(links).withColumnRenamed("id", "rep")
        classes = needed(C.kept(full.groupBy("digest").agg(F.min("doc_id").alias("rep")).join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))))
    out = every.select("doc_id", "key", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("key").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
