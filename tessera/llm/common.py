"""What the operators of this subpackage share: batches of bytes, rolling hashes, scratch tables, components.

Text columns reach Python as Arrow binary arrays and are worked on as one flat byte
buffer with offsets, a slice of at most SLICE bytes at a time, so that a worker's
memory follows the slice (or the single longest document), never the partition.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.iterate import kept, scope  # noqa: F401

SLICE = 1 << 18
ROWS_A_BATCH = 1024

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd base and its inverse modulo 2**64, and a random word for each byte.
BASE = int(_rng.integers(1 << 62, dtype=np.uint64)) * 2 + 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_WORD = _rng.integers(1 << 63, size=256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[tuple[int, int], np.ndarray] = {}
#: A Mersenne prime, and two random bases below it with a random nonzero number for each byte.
PRIME = U((1 << 31) - 1)
LANES = [(int(_rng.integers(1 << 20, int(PRIME))), _rng.integers(1, int(PRIME), size=256, dtype=np.uint64)) for _ in range(2)]


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class small_batches:
    """Arrow batches of few rows from now on: their bytes follow the rows, and texts may be long.

    As a context it gives the session its setting back. Operators that return a plan not yet run can't: the plan reads
    the setting when it runs. Those leave it lowered, which changes no result.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.conf, self.before = spark.conf, spark.conf.get(BATCH_ROWS)
        if not 0 < int(self.before) <= ROWS_A_BATCH:
            self.conf.set(BATCH_ROWS, str(ROWS_A_BATCH))

    def __enter__(self) -> small_batches:
        return self

    def __exit__(self, *_: object) -> None:
        self.conf.set(BATCH_ROWS, self.before)


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a column key: doc_id, or null where the row isn't the document of its doc_id.

    doc_id should be unique. Where rows share one but not the text, the document is that whose text has the least hash; rows that
    repeat it whole are the document once more. doc_ids with several texts are few, so the join has a small side.
    """
    doc_id, h, low = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), f"_{uuid.uuid4().hex}"
    several = docs.select(doc_id.alias(key), h.alias("h")).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("h").alias(low), F.max("h").alias("high")).where(F.col(low) < F.col("high"))
    several = kept(several.select(key, low))
    if several.isEmpty():
        return docs.withColumn(key, doc_id)
    own = docs.withColumn(key, doc_id).join(several, key, "left")
    return own.withColumn(key, F.when(F.coalesce(F.col(low), h) == h, F.col(key))).select(*(docs[c] for c in docs.columns), key)


def replaced(docs: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """docs (with the key column of keyed) with the text of new (doc_id, text) for the documents in it; all other rows and columns as they are, without the key.

    The names that the join needs are none of docs.
    """
    names = [f"_{uuid.uuid4().hex}" for _ in range(2)]
    new = new.select(F.col("doc_id").alias(names[0]), F.col("text").alias(names[1])).dropDuplicates([names[0]])
    joined = docs.join(new, docs[key] == new[names[0]], "left")
    text = F.when(F.col(names[0]).isNull(), docs["text"]).otherwise(F.col(names[1])).alias("text")
    return joined.select(*(text if c == "text" else docs[c] for c in docs.columns if c != key))


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose column has at most limit bytes together (a longer row comes alone)."""
    for batch in batches:
        data, offs = flat(batch.column(column))
        a, n = 0, len(offs) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1 ... modulo 2**64."""
    have = _powers.get((0, base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 1), base & (2**64 - 1), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 8 * SLICE:
            _powers[0, base] = have
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H[i] = sum of word(data[j]) * BASE**j for j < i, modulo 2**64.

    Fast, and good to choose places by; but some different strings (Thue-Morse ones) agree whatever the base,
    so whether strings are equal is for Prefixes to say.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_WORD[data] * powers(BASE, len(data)), out=out[1:])
    return out


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**63."""
    x = (x & PRIME) + (x >> U(31))
    x = (x & PRIME) + (x >> U(31))
    return np.minimum(x, x - PRIME)  # x - PRIME wraps to a large number where x is below PRIME


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1 ... modulo PRIME."""
    have = _powers.get((1, base))
    if have is None or len(have) < n:
        have = np.ones(max(n, SLICE + 1), np.uint64)
        k, step = 1, base
        while k < len(have):
            have[k : 2 * k] = reduced(have[:k] * U(step))[: len(have) - k]
            k, step = 2 * k, step * step % int(PRIME)
        if len(have) <= 8 * SLICE:
            _powers[1, base] = have
    return have[:n]


class Prefixes:
    """Prefix polynomial hashes modulo a prime in two lanes, with random bases.

    Two different strings of n bytes agree with a probability of (n / PRIME)**2 over the bases, whatever the strings.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.lanes = []
        n = len(data)
        for base, words in LANES:
            v = words[data] * prime_powers(base, n)
            h = np.zeros(n + 1, np.uint64)
            np.cumsum((v & PRIME) + (v >> U(31)), out=h[1:])
            self.lanes.append((reduced(h), prime_powers(base, n + 1), prime_powers(pow(base, -1, int(PRIME)), n + 1)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The mixed hash of each data[start:end], the same wherever the bytes stand."""
        out = np.zeros(len(start), np.uint64)
        for h, _, inverse in self.lanes:
            out = out << U(31) | reduced((h[end] + PRIME - h[start]) * inverse[start])
        return mix(out)

    def same(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Whether the hashes of n bytes from x and from y agree."""
        out = np.ones(len(x), bool)
        for h, p, _ in self.lanes:
            out &= reduced((h[x + n] + PRIME - h[x]) * p[y]) == reduced((h[y + n] + PRIME - h[y]) * p[x])
        return out


def equal_spans(one: np.ndarray, a: np.ndarray, n: np.ndarray, many: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n bytes of one from a are the m bytes of many from b, for each pair, byte by byte."""
    out = n == m
    use = np.flatnonzero(out & (n > 0))
    if len(use):
        cut = np.concatenate(([0], np.cumsum(n[use])[:-1]))
        k = np.arange(int(n[use].sum())) - np.repeat(cut, n[use])
        out[use] = np.logical_and.reduceat(one[np.repeat(a[use], n[use]) + k] == many[np.repeat(b[use], n[use]) + k], cut)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser whose every output bit depends on every input bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with is_word, none across two rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = is_word[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = w[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def binaries(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column from its bytes and offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of edges (a, b); see _components."""
    with scope() as needed:
        return needed(kept(_components(edges)))


def _components(edges: DataFrame) -> DataFrame:
    """(id, component) with the smallest id reachable, for every id of edges (a, b).

    Alternates large-star and small-star steps until all edges are stars; each step is one
    group minimum with map-side combine and one join, and its table is written, so no
    task holds a node's whole neighbourhood and lost executors cost one step.
    """
    e = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join has two plain exchanges, whose skewed partitions Spark splits.
        low = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u <> v").distinct())
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = kept(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))


def _stars(e: DataFrame) -> bool:
    """Whether each u of the edges (u, v), u > v, has one v, which is no u: then v is the least of its component."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    met = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return met.where(F.col("out") + F.col("in") > 1).where("out > 0").isEmpty()


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for rows at about so many each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / each))
