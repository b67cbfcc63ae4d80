"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Tokens: a public tokenizer's ids and one end id per document. A text is cut at spaces and
newlines, where this tokenizer's pre-tokenizer always cuts and neither lower-casing nor
normalization looks across; each distinct word is encoded once and its ids are gathered
back. Documents longer than the capacity become full pieces and a last one.

Packing: pieces are dealt evenly by a hash and sorted by length, longest first, in each task; each goes
into the open sequence with the least free space that takes it. Open sequences are kept
in lists by free space, and a bitset has a bit for each free space with an open
sequence, so the best fit is the lowest set bit at or above the need. At most OPEN
sequences are open; when one more is needed the fullest, the lowest bit, closes first.
Each task leaves at most a few sequences that more pieces could have filled.

Null and empty texts are one end id. Rows with the same doc_id are packed as rows of
their own. Ties are broken by doc_id and piece, so a task that runs again gives the same
sequences (rows that agree in all columns may change places).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common as C

CAPACITY, OPEN, END = 2048, 4096, 0
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a worker remembers, over all its tasks; when full it starts afresh.
REMEMBERED = 1_000_000
#: Plain words that are encoded as one line; the tokens that end a word tell them apart again.
LINE = 256
#: Pieces that one task packs, at the least; with fewer in all, one task has them.
EACH = 4000


class Words:
    """A tokenizer that encodes each distinct word once for as long as it is remembered.

    Before texts are cut at spaces, a full stop or comma after a Latin letter is set off by a
    space: the pre-tokenizer cuts there too and drops spaces. A-Z are lower-cased first, as the
    tokenizer does, unless the texts may hold the tokenizer's special strings.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        own = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(own.values()) + 1, bool)
        self.ends[[i for w, i in own.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, new: list[str]) -> None:
        """Words of lower-case Latin letters only are one token run each, which ends with an end token."""
        plain = np.asarray(pc.match_substring_regex(pa.array(new, pa.string()), "^[a-zà-öø-ÿ]+$"))
        words = [new[i] for i in np.flatnonzero(plain)]
        lines = [words[a : a + LINE] for a in range(0, len(words), LINE)]
        encoded = self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)
        for line, e in zip(lines, encoded, strict=True):
            ids = np.array(e.ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(line) and stop[-1] == len(ids):
                self.add(line, ids, stop)
            else:
                self.learn_each(line)
        self.learn_each([new[i] for i in np.flatnonzero(~plain)])

    def learn_each(self, new: list[str]) -> None:
        if new:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.add(new, np.array([i for x in lists for i in x], np.uint32), np.cumsum([len(x) for x in lists]))

    def add(self, words: list[str], ids: np.ndarray, stop: np.ndarray) -> None:
        self.known |= zip(words, range(len(self.known), len(self.known) + len(words)), strict=True)
        self.waiting.append((ids, stop))

    def settle(self) -> None:
        """Put what was learned behind the tables, at once."""
        if self.waiting:
            base = self.first[-1] + np.concatenate(([0], np.cumsum([len(i) for i, _ in self.waiting])))
            self.table = np.concatenate((self.table, *(i for i, _ in self.waiting)))
            self.first = np.concatenate((self.first, *(s + b for (_, s), b in zip(self.waiting, base, strict=False))))
            self.waiting = []

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8 bytes and offsets), end to end, and the n + 1 offsets of the texts."""
        if b"<|" not in data.tobytes():
            data = C.LOWER[data]
        # A fresh array: some string kernels of Arrow misread slices of one.
        texts = C.binaries(data, offs).cast(pa.large_binary()).cast(pa.large_string())
        apart = pc.replace_substring_regex(texts, r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])", r"\1 \2")
        words = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        per = np.asarray(words.value_lengths())
        coded = words.flatten().dictionary_encode()
        index, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = distinct
        if new:
            self.learn(new)
            self.settle()
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[index] if len(index) else np.zeros(0, np.int64)
        start, n = self.first[place], self.first[place + 1] - self.first[place]
        at = np.concatenate(([0], np.cumsum(n)))
        ids = self.table[np.repeat(start - at[:-1], n) + np.arange(at[-1])]
        return ids, at[np.concatenate(([0], np.cumsum(per)))]


#: Of a worker, by vocabulary.
_words: dict[str, Words] = {}


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, tokens: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs (doc_id, text); with tokens also ids."""
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tessera.llm import packing  # the worker's own module, which outlives the task

        if vocabulary not in packing._words:
            packing._words[vocabulary] = Words(vocabulary)
        w = packing._words[vocabulary]
        for batch in batches:
            for rows, data, offs in C.slices([batch], limit=8 << 20):
                ids, at = w.ids(data, offs)
                n = np.diff(at) + 1
                full = np.full(int(n.sum()), end, "<u4")
                base = np.concatenate(([0], np.cumsum(n)))
                full[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                count = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                a = base[row] + start
                crc = [zlib.crc32(full[i : i + k].data) for i, k in zip(a.tolist(), length.tolist(), strict=True)]
                cols = [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if tokens:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * tokens
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, shape)


class Packer:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN) -> None:
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n = 0

    def put(self, need: int) -> tuple[int, int]:
        """(sequence, offset) of the next piece."""
        fits = self.bits >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            bin_ = self.open[free].pop()
            if not self.open[free]:
                self.bits ^= 1 << free
            self.n_open -= 1
        else:
            free, bin_ = self.capacity, self.n
            self.n += 1
            if need < free and self.n_open == self.most:
                low = (self.bits & -self.bits).bit_length() - 1
                self.open[low].pop()
                if not self.open[low]:
                    self.bits ^= 1 << low
                self.n_open -= 1
        left = free - need
        if left:
            self.open[left].append(bin_)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_, self.capacity - free


def packed(cut: DataFrame, capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """The rows of cut (doc_id, piece, start, length ...) with sequence_id and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(capacity, most)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            got = [p.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    rows = cut.count()
    n = max(1, rows // EACH) if rows < 100 * EACH else C.parts(cut.sparkSession, rows, 10 * EACH)
    kinds = ", ".join(f"`{c}` {k}" for c, k in cut.dtypes)
    dealt = cut.repartition(n, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(run, kinds + ", sequence_id long, `offset` long")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, most: int = OPEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of docs (doc_id, text)."""
    return packed(C.kept(pieces(docs, vocabulary, capacity)), capacity, most)
