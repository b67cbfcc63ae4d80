"""Benchmark decontamination with an FM-index per training shard.

A word is a maximal run of digits, letters and bytes above 127 of the lower-cased text. A
phrase is each run of `window` words of a benchmark item, or the whole item where it has
fewer. Every word of a document inside an occurrence of a phrase is hit.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, each sent to all tasks; so
what is broadcast has a proven size. For each block, a task turns its documents into
shards of word numbers over the block's vocabulary. A word outside it can't take part in
any phrase, so a run of such words becomes one separator, and runs of known words shorter
than the shortest phrase are dropped: the index covers exactly the stretches in which
phrases can occur. Each shard is sorted by suffix (prefix doubling), its Burrows-Wheeler
transform goes into a wavelet tree with sampled ranks, and all phrases of the block are
searched backward together, word by word. Occurrences are located by walking to the
sampled suffix positions, the words there are compared with the phrase's byte by byte, and
overlapping spans are merged per document. An item longer than a block is taken in parts that overlap by a window less one word.
With more than one block, the documents are written once with a row number, so that each block's findings can be put together.

Null texts have no words; an item without words has no phrase, one without an id is no item. Repeated rows
are documents of their own; item ids are compared as strings; items with one id are one item. A row with a null doc_id is
judged like others, and rows that share a doc_id each by their own text. Other columns are passed by, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Word numbers of one shard's index, about; a single document may have more.
SHARD = 1 << 18
SAMPLE = 8
RANKS = 64


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end) of each word of the rows; start and end are places in data."""
    data = C.LOWER[data]
    start, end = C.word_spans(data, offs, WORD)
    return np.searchsorted(offs, start, "right") - 1, C.Prefixes(data).spans(start, end), start, end


def equal_words(one: np.ndarray, start: np.ndarray, end: np.ndarray, i: np.ndarray, many: np.ndarray, first: np.ndarray, last: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the i-th words of one are the j-th words of many."""
    return C.equal_spans(one, start[i], end[i] - start[i], many, first[j], last[j] - first[j])


class Phrases:
    """The distinct phrases of a block of items, over the numbered vocabulary of the block.

    Numbers start at 1; 0 is the separator. Words whose hashes agree have one number; phrases are told apart by their bytes.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        offs = np.concatenate(([0], np.cumsum([len(t) for _, t in items]))).astype(np.int64)
        self.data = C.LOWER[np.frombuffer(b"".join(t for _, t in items), np.uint8)]
        row, h, self.start, self.end = words(self.data, offs)
        self.vocabulary, first, number = np.unique(h, return_index=True, return_inverse=True)
        exact = number
        if not equal_words(self.data, self.start, self.end, np.arange(len(h)), self.data, self.start, self.end, first[number]).all():
            seen: dict[bytes, int] = {}
            exact = np.array([seen.setdefault(self.data[x:y].tobytes(), len(seen)) for x, y in zip(self.start.tolist(), self.end.tolist(), strict=True)])
        number, exact = number.astype(np.int64) + 1, exact.astype(np.int64)
        found: dict[bytes, tuple[int, list[int]]] = {}
        self.words: list[np.ndarray] = []
        self.items: list[list[int]] = []
        self.names = [i for i, _ in items]
        spot: list[int] = []
        cut = np.searchsorted(row, np.arange(len(items) + 1)).tolist()
        for k in range(len(items)):
            n = cut[k + 1] - cut[k]
            for a in range(cut[k], cut[k] + (max(1, n - window + 1) if n else 0)):
                b = min(a + window, cut[k + 1])
                at = found.setdefault(exact[a:b].tobytes(), (len(self.words), []))
                if at[0] == len(self.words):
                    self.words.append(number[a:b])
                    self.items.append([])
                    spot.append(a)
                if not self.items[at[0]] or self.items[at[0]][-1] != k:
                    self.items[at[0]].append(k)
        #: The number of each phrase's first word among all words of the block.
        self.spot = np.array(spot, np.int64)
        self.size = np.array([len(p) for p in self.words], np.int64)
        self.shortest = int(self.size.min()) if len(self.size) else 0
        self.table = np.zeros((len(self.words), int(self.size.max()) if len(self.size) else 0), np.int64)
        for k, p in enumerate(self.words):
            self.table[k, : len(p)] = p

    def stand(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether each phrase stands at that word of data, byte by byte."""
        out = np.ones(len(phrase), bool)
        for k in range(self.table.shape[1]):
            use = np.flatnonzero(out & (k < self.size[phrase]))
            out[use] = equal_words(data, start, end, word[use] + k, self.data, self.start, self.end, self.spot[phrase[use]] + k)
        return out

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word hash, 0 outside the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def suffix_order(x: np.ndarray) -> np.ndarray:
    """The suffixes of x in order, by prefix doubling."""
    n = len(x)
    _, rank = np.unique(x, return_inverse=True)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


class Bits:
    """A bit vector whose ranks are counts at every RANKS bits and a popcount."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // RANKS + 1) * RANKS, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.counts = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        w = i // RANKS
        inside = self.words[w] & ((C.U(1) << (i % RANKS).astype(np.uint64)) - C.U(1))
        return self.counts[w] + np.bitwise_count(inside).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i // RANKS] >> (i % RANKS).astype(np.uint64) & C.U(1)).astype(np.int64)


class Wavelet:
    """A wavelet tree, level by level (zeros before ones), over numbers below 2 ** depth."""

    def __init__(self, x: np.ndarray) -> None:
        self.depth = max(1, int(x.max()).bit_length()) if len(x) else 1
        self.levels: list[tuple[Bits, int]] = []
        for d in range(self.depth - 1, -1, -1):
            bit = (x >> d & 1).astype(np.uint8)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        lo, hi = np.zeros(len(i), np.int64), i.copy()
        for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = c >> d & 1
            a, b = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at i, and how often it occurs before i."""
        c, lo, at = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i.copy()
        for bits, zeros in self.levels:
            one = bits.get(at)
            a, b = bits.rank(lo), bits.rank(at)
            c = c * 2 + one
            lo, at = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, at - b)
        return c, at - lo


class FMIndex:
    """Backward search over a sequence of numbers. All are raised by 1; a single 0 ends it."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = np.concatenate((x + 1, [0]))
        order = suffix_order(self.x)
        self.tree = Wavelet(self.x[order - 1])
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.x, minlength=int(self.x.max()) + 1))))
        self.sampled = Bits((order % SAMPLE == 0).astype(np.uint8))
        self.places = order[order % SAMPLE == 0]
        self.rows = len(order)

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each phrase (a row of phrases, its first `size` numbers)."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.rows, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            go = np.flatnonzero((k < size) & (lo < hi))
            c = phrases[go, k] + 1
            known = c < len(self.first) - 1
            base = self.first[np.where(known, c, 0)]
            lo[go] = np.where(known, base + self.tree.rank(c, lo[go]), 0)
            hi[go] = np.where(known, base + self.tree.rank(c, hi[go]), 0)
        return lo, np.maximum(hi, lo)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The place of the suffix of each row, by steps to the left up to a sampled one."""
        out, steps, live, at = np.empty(len(row), np.int64), 0, np.arange(len(row)), row.copy()
        while len(live):
            hit = self.sampled.get(at).astype(bool)
            out[live[hit]] = self.places[self.sampled.rank(at[hit])] + steps
            live, at = live[~hit], at[~hit]
            c, before = self.tree.get(at)
            at = self.first[c] + before
            steps += 1
        return out


def occurrences(x: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place) of every occurrence of a phrase in x."""
    index = FMIndex(x)
    lo, hi = index.search(p.table, p.size)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    row = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n) + lo[phrase] if len(n) else np.zeros(0, np.int64)
    return phrase, index.locate(row)


def shard_hits(row: np.ndarray, number: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word, size): occurrences by the place of their first word among all words; row: each word's document."""
    known = number > 0
    edge = np.ones(len(row), bool)
    edge[1:] = (row[1:] != row[:-1]) | (known[1:] != known[:-1])
    lot = np.cumsum(edge) - 1
    long = known & (np.bincount(lot)[lot] >= p.shortest) if len(row) else known
    use = np.flatnonzero(long)
    if not len(use):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    # A separator before each run: its words keep their order and no phrase crosses runs.
    new = np.ones(len(use), bool)
    new[1:] = lot[use[1:]] != lot[use[:-1]]
    at = np.arange(len(use)) + np.cumsum(new)
    x = np.zeros(at[-1] + 1, np.int64)
    x[at] = number[use]
    back = np.zeros(len(x), np.int64)
    back[at] = use
    phrase, place = occurrences(x, p)
    return phrase, back[place], p.size[phrase]


PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def hits(docs: DataFrame, items: list[tuple[str, bytes]], window: int, cut: str | None = None, last: bool = True) -> DataFrame:
    """For one block of items: doc_id, row_id, n_words, n_hit, hit (ranges of words) and the items that occur, of each row of docs.

    With cut, the name of a column of docs, docs instead with the word ranges of the hits united with those in that column; for the last
    block as byte ranges.
    """
    C.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(items)
    cache: dict[int, Phrases] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = cache.setdefault(0, Phrases(sent.value, window)) if 0 not in cache else cache[0]

        def shard(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            base, far, rows, begin, finish = 0, 0, [], [], []
            for r, _, data, n, _, start, end in held:
                rows.append(r + base)
                begin.append(start + far)
                finish.append(end + far)
                base += n
                far += len(data)
            row, num = np.concatenate(rows), np.concatenate([x[4] for x in held])
            phrase, word, size = shard_hits(row, num, p)
            if len(phrase):
                right = p.stand(np.concatenate([x[2] for x in held]), np.concatenate(begin), np.concatenate(finish), phrase, word)
                phrase, word, size = phrase[right], word[right], size[right]
            doc = row[word] if len(word) else word
            at = 0
            first_word = np.searchsorted(row, np.arange(base + 1))
            for _, rb, _, n, _, start, end in held:
                mine = (doc >= at) & (doc < at + n)
                d, w, s, f = doc[mine] - at, word[mine], size[mine], phrase[mine]
                order = np.lexsort((w, d))
                d, w, s, f = d[order], w[order], s[order], f[order]
                of = np.searchsorted(d, np.arange(n + 1))
                merged, names, n_hit = [], [], []
                for i in range(n):
                    a, b = of[i], of[i + 1]
                    spans_ = []
                    base_word = first_word[at + i]
                    for x, k in zip(w[a:b].tolist(), s[a:b].tolist(), strict=True):
                        if spans_ and x <= spans_[-1][1]:
                            spans_[-1][1] = max(spans_[-1][1], x + k)
                        else:
                            spans_.append([x, x + k])
                    n_hit.append(sum(y - x for x, y in spans_))
                    merged.append([(x - base_word, y - base_word) for x, y in spans_])
                    names.append(sorted({p.names[k] for q in set(f[a:b].tolist()) for k in p.items[q]}))
                if cut:
                    off, word0 = held_offs[id(rb)], first_word[at]
                    have = rb.column(cut).to_pylist()
                    for i in range(n):
                        if merged[i] or have[i]:
                            have[i] = united((have[i] or []) + [{"a": int(x), "b": int(y)} for x, y in merged[i]])
                            if last:
                                base_word = first_word[at + i] - word0
                                have[i] = [{"a": int(start[base_word + x["a"]] - off[i]), "b": int(end[base_word + x["b"] - 1] - off[i])} for x in have[i]]
                    yield pa.RecordBatch.from_arrays([pa.array(have, PAIRS) if c == cut else rb.column(c) for c in rb.schema.names], names=rb.schema.names)
                else:
                    n_words = np.diff(first_word[at : at + n + 1])
                    pairs = pa.array([[{"a": int(x), "b": int(y)} for x, y in m] for m in merged], PAIRS)
                    cols = [rb.column("doc_id"), rb.column("row_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pairs, pa.array(names, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_id", "n_words", "n_hit", "hit", "items"])
                at += n

        held, size = [], 0
        held_offs: dict[int, np.ndarray] = {}
        for rows, data, offs in C.slices(batches):
            r, h, start, end = words(data, offs)
            held.append((r, rows, C.LOWER[data], len(offs) - 1, p.numbers(h), start, end))
            held_offs[id(rows)] = offs
            size += len(h)
            if size >= SHARD:
                yield from shard(held)
                held, size = [], 0
                held_offs.clear()
        if held:
            yield from shard(held)

    if cut:
        return docs.mapInArrow(run, docs.schema)
    return docs.mapInArrow(run, "doc_id long, row_id long, n_words long, n_hit long, hit array<struct<a: long, b: long>>, items array<string>")


def united(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """The union of spans as ascending disjoint ones."""
    out: list[dict[str, int]] = []
    for x in sorted(spans, key=lambda x: x["a"]):
        if out and x["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], x["b"])
        else:
            out.append(dict(x))
    return out


def parts(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """text, or where it is longer than most, stretches of about as many bytes that have its windows between them."""
    if len(text) <= most:
        yield text
        return
    data = np.frombuffer(text, np.uint8)
    _, _, start, end = words(data, np.array([0, len(data)]))
    a = 0
    while a < len(start):
        b = max(a + window, int(np.searchsorted(end, start[a] + most, "right")))
        if len(start) - b < window:
            b = len(start)
        yield text[start[a] : end[b - 1]]
        if b == len(start):
            return
        a = b - window + 1


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about `most` bytes of text at most, one block on the driver at a time."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")).where("i is not null")
    for r in rows.toLocalIterator(prefetchPartitions=False):
        for t in parts(bytes(r.t), window, most):
            if held and size + len(t) > most:
                yield held
                held, size = [], 0
            held.append((r.i, t))
            size += len(t)
    yield held


def found(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, hit (merged word ranges) and items of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("binary").alias("text"))
    each = blocks(benchmark, most, window)
    block, nxt = next(each), next(each, None)
    if nxt is None:
        return hits(docs, block, window)
    docs = C.kept(docs)
    out = hits(docs, block, window).unionByName(hits(docs, nxt, window))
    for block in each:
        out = out.unionByName(hits(docs, block, window))
    # The same document's ranges from several blocks: merged once more.
    merge = """aggregate(array_sort(flatten(collect_list(hit))), cast(array() as array<struct<a: bigint, b: bigint>>), (s, x) ->
        if(size(s) > 0 and x.a <= element_at(s, -1).b, concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).a as a, greatest(element_at(s, -1).b, x.b) as b))), concat(s, array(x))))"""
    out = out.groupBy("doc_id", "row_id", "n_words").agg(F.expr(merge).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.withColumn("n_hit", F.expr("aggregate(hit, 0L, (s, x) -> s + x.b - x.a)"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs (doc_id, text)."""
    return found(docs, benchmark, window, most).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> DataFrame:
    """docs without the bytes from the first to the last word of each merged span of its text; texts without a span stay as they are.

    Each row is judged by its own text and carries its spans through the blocks, so there is no join and doc_id doesn't matter.
    """
    cut = f"_{uuid.uuid4().hex}"
    out = docs.withColumn("text", F.col("text").cast("string")).withColumn(cut, F.lit(None).cast("array<struct<a: bigint, b: bigint>>"))
    each = blocks(benchmark, most, window)
    block = next(each)
    while block is not None:
        nxt = next(each, None)
        out = hits(out, block, window, cut, nxt is None)
        block = nxt
    # The bytes between the spans: from each one's end to the next one's start.
    rest = f"""decode(aggregate(transform(sequence(0, size({cut})), i -> struct(if(i = 0, 0L, {cut}[i - 1].b) as a, if(i = size({cut}), cast(octet_length(text) as bigint), {cut}[i].a) as b)),
        cast('' as binary), (s, x) -> concat(s, substring(encode(text, 'utf-8'), cast(x.a + 1 as int), cast(x.b - x.a as int)))), 'utf-8')"""
    return out.withColumn("text", F.when(F.size(F.coalesce(cut, F.array())) > 0, F.expr(rest)).otherwise(F.col("text"))).drop(cut)
