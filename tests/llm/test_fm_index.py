import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import fm_index as X

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def brute(docs, items, window=10):
    out = set()
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= g
        out.add((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def data(seed):
    r = random.Random(seed)
    vocab = [*"a b c dé e f g h".split(), "Über", "x9", "don't", "w_z"]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, prose(r.choice([12, 14, 20, 30]))) for i in range(30)] + [(100, None), (101, " - "), (102, "q1 q2"), (103, "q1"), (104, "One two three.")]
    docs = [(0, None), (1, ""), (2, "q1, Q2! q1"), (3, "one TWO\nthree")]
    for i in range(10, 70):
        t = prose(r.randrange(60)) + " outsider " + prose(5)
        if r.random() < 0.6:
            t += " " + r.choice(items[:30])[1].upper() + ", " + prose(3)
        docs.append((i, t))
    return docs, items


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_against_brute_force(spark, most):
    docs, items = data(most)
    got = X.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert {tuple(x) for x in got.collect()} == brute(docs, items)


def test_index_counts_and_places():
    r = np.random.default_rng(1)
    x = r.integers(0, 6, 700)
    index = X.FMIndex(x)
    for n in (1, 2, 3, 5):
        p = r.integers(1, 6, (40, n))
        lo, hi = index.search(p, np.full(40, n))
        for k in range(40):
            want = [i for i in range(len(x) - n + 1) if (x[i : i + n] == p[k]).all()]
            assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Keep this. SECRET-phrase one! and this", "x"), (2, None, "y"), (3, "secret phrase two", "z")], "doc_id long, text string, n_words string")
    items = spark.createDataFrame([("i", "secret phrase one")], "item_id string, text string")
    docs = docs.union(spark.createDataFrame([(None, "a secret phrase one b", "v"), (1, "Another secret phrase one", "w"), (3, "secret phrase two", "z")], docs.schema))
    items = items.union(spark.createDataFrame([("j", "keep this")], items.schema))
    want = [(1, "! and this", "x"), (2, None, "y"), (3, "secret phrase two", "z"), (None, "a  b", "v"), (1, "Another ", "w"), (3, "secret phrase two", "z")]
    for most in (X.BLOCK_BYTES, 1):
        assert sorted(map(repr, map(tuple, X.decontaminated(docs, items, most=most).collect()))) == sorted(map(repr, want))
    none = spark.createDataFrame([], "item_id string, text string")
    assert {x.n_hit for x in X.contamination(docs, none).collect()} == {0}
    assert X.contamination(docs.limit(0), items).collect() == []


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_are_compared_by_their_bytes(spark, monkeypatch):
    one = thue_morse(1024)
    two = one.translate({97: "b", 98: "a"})
    nine = "p q r s t u v w x"
    docs, items = [(1, f"{nine} {one} y"), (2, f"{nine} {two} y"), (3, f"{two} {nine} {two}")], [("i", f"{nine} {two}"), ("j", f"{one} {nine}")]

    def check():
        got = X.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
        assert {tuple(x) for x in got.collect()} == brute(docs, items)

    check()
    p = X.Phrases([(i, t.encode()) for i, t in items], 10)
    # Even if all hashes of words of one length agreed.
    monkeypatch.setattr(X.C.Prefixes, "spans", lambda self, start, end: (end - start).astype(np.uint64))
    p = X.Phrases([(i, t.encode()) for i, t in items], 10)
    assert len(p.vocabulary) == 2 and len(p.words) == 2
    text = np.frombuffer(" ".join(t for _, t in docs).encode(), np.uint8)
    row, h, start, end = X.words(text, np.array([0, len(text)]))
    phrase, word, _ = X.shard_hits(row, p.numbers(h), p)
    right = p.stand(text, start, end, phrase, word)
    assert sorted(word[right].tolist()) == [11, 23] and len(word) > 2


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_long_items_are_taken_in_parts(spark, most):
    r = random.Random(6)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    item = prose(200)
    w = item.split()
    assert {tuple(p.split()[k : k + 10]) for p in X.parts(item.encode(), 10, most) for k in range(len(p.split()) - 9)} == {tuple(x.encode() for x in w[k : k + 10]) for k in range(191)}
    docs = [(i, " ".join(w[a : a + r.randrange(5, 40)]) + " " + prose(3)) for i, a in enumerate(range(0, 195, 3))]
    items = [("x", item), ("x", prose(12)), ("y", prose(5))]
    got = X.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), most=most)
    assert {tuple(x) for x in got.collect()} == brute(docs, items)
