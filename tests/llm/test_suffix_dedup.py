import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S


def brute(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    met = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = set()
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if met[b[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        keep = bytes(x for x, g in zip(b, gone) if not g)
        out.add((i, len(b), len(b) - len(keep), spans, hashlib.sha256(keep).hexdigest()))
    return out


def rows(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (40, 60, 70, 90, 200)]
    out = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 900), (4, "y" * 200), (5, "y" * 200), (6, "line of text. " * 60)]
    for i in range(10, 60):
        t = prose(r.randrange(5, 200))
        for s in r.sample(shared, r.randrange(3)):
            t = t + s[r.randrange(10) :] + prose(20)
        out.append((i, t))
    base = prose(300)
    for i in range(60, 90):
        w = base.split(" ")
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = word()
        out.append((i, " ".join(w)))
    out += [(90, base), (91, base), (92, base)]
    return out


@pytest.mark.parametrize("full", [1024, 6, 1])
def test_against_brute_force(spark, full):
    data = rows(full)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {tuple(x) for x in S.removed(df, full=full).collect()} == brute(data)


def test_one_passage_in_thousands_of_documents(spark):
    """Its pieces at both ends are different in each document; over FULL of them share an anchor."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, ends = prose(60), [prose(3), prose(30)]
    data = [(i, prose(r.randrange(1, 12)) + r.choice(["", ends[0]]) + passage + r.choice(["", ends[1]]) + prose(r.randrange(40))) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    assert {tuple(x) for x in S.removed(df).collect()} == brute(data)


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_strings_whose_hash_modulo_a_power_of_two_agrees(spark):
    one = thue_morse(1024)
    two = one.translate({97: "b", 98: "a"})
    data = [(1, "x" * 10 + one), (2, "y" * 10 + two), (3, one[:300] + two[:700]), (4, two[:500] + "z" + one[300:])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {tuple(x) for x in S.removed(df).collect()} == brute(data)
    both = np.frombuffer((one + two).encode(), np.uint8)
    h = S.C.Prefixes(both)
    assert not h.same(np.array([0]), np.array([1024]), 1024)[0]


def test_suffix_order_is_that_of_bytes():
    r = np.random.default_rng(3)
    data = r.integers(97, 99, 3000).astype(np.uint8)
    start = np.arange(2500)
    s = S.Suffixes(data, 200)
    got = s.sorted(start, np.zeros(len(start), np.int64))
    b = data.tobytes()
    assert [b[i : i + 200] for i in got] == sorted(b[i : i + 200] for i in start)


def test_empty_table(spark):
    assert S.removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
