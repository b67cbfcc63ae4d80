import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tessera.llm import common as C, packing as P

T = Tokenizer.from_file(P.VOCABULARY)


def ids(text):
    return [*T.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, got, capacity=2048):
    want = {}
    for i, t in rows:
        x = ids(t)
        for k in range(0, len(x), capacity):
            part = x[k : k + capacity]
            want[i, k // capacity] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), first_fit(sorted((n for _, n, _ in want.values()), reverse=True), capacity)


def first_fit(needs, capacity):
    bins = []
    for n in needs:
        k = next((k for k, b in enumerate(bins) if b + n <= capacity), None)
        if k is None:
            bins.append(n)
        else:
            bins[k] += n
    return len(bins)


def test_round_trip(spark):
    r = random.Random(5)
    words = "The cat, ÉCOLE don't 12345 x_y naïve <|endoftext|> É. a.b.,c, ×. ÿ,, <|ENDOFTEXT|> 日本語 á !!!  nb\tt".split(" ")
    rows = [(0, None), (1, ""), (2, " \n "), (3, "word " * 9000), (4, "a\x1cb  c\rd")]
    rows += [(i, "".join(r.choice(words) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randrange(1, 900)))) for i in range(5, 120)]
    n, plain = check(rows, P.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert n <= plain


def test_words_without_special_strings(spark):
    rows = [(1, "The É. end, of.a U.S.A. thing,, o'Clock. 3,5 x.'s ×. ÿ, Ω. «a.» İI. " * 40), (2, "ends.\u0301 with, marks")]
    check(rows, P.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_slices_of_a_batch():
    r = random.Random(2)
    texts = ["".join(r.choice(["É", "ß.", "The ", " ", "ÿ,", "x", "日", "\n", "Ab. "]) for _ in range(r.randrange(80))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""])], names=["text"])
    w, got = P.Words(P.VOCABULARY), []
    for _, data, offs in C.slices([batch.slice(1)], limit=500):
        x, at = w.ids(data, offs)
        got += [x[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert got == [ids(t)[:-1] for t in [*texts[1:], None, ""]]


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_bounded_best_fit_against_plain_lists(needs, most):
    p, bins, open_ = P.Packer(50, most), [], []
    for need in needs:
        b, o = p.put(need)
        fit = [x for x in open_ if 50 - bins[x] >= need]
        if fit:
            assert 50 - bins[b] == min(50 - bins[x] for x in fit) and b in fit
        else:
            if need < 50 and len(open_) == most:
                open_.remove(max(open_, key=lambda x: bins[x]) if len({bins[x] for x in open_}) == len(open_) else next(x for x in reversed(open_) if bins[x] == max(bins[y] for y in open_) and x not in p.open[50 - bins[x]]))
            bins.append(0)
            assert b == len(bins) - 1
        assert o == bins[b]
        bins[b] += need
        if b in open_:
            open_.remove(b)
        if bins[b] < 50:
            open_.append(b)
        assert sorted(open_) == sorted(x for s in p.open for x in s) and len(open_) <= most
