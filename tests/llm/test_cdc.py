import hashlib
import random
from collections import defaultdict

import numpy as np

from tessera.llm import cdc as D

G = [int(x) for x in D.GEAR]


def plain_chunks(b):
    h, last, out = 0, 0, []
    for i, c in enumerate(b):
        h = ((h << 1) + G[c]) & 0xFFFFFFFF
        n = i + 1 - last
        if n == D.MOST or n >= D.LEAST and i >= D.SEEN - 1 and h >> (32 - D.AVERAGE_BITS) == 0:
            out.append((last, i + 1))
            last = i + 1
    return out + [(last, len(b))] * (last < len(b))


def brute(rows):
    places, cuts = defaultdict(set), {}
    for i, t in rows:
        b = (t or "").encode()
        cuts[i] = plain_chunks(b)
        for x, y in cuts[i]:
            places[b[x:y]].add((i, x))
    out = set()
    for i, t in rows:
        b = (t or "").encode()
        runs, removed = [], []
        for x, y in cuts[i]:
            if len(places[b[x:y]]) > 1:
                if runs and runs[-1][-1][1] == x:
                    runs[-1].append((x, y))
                else:
                    runs.append([(x, y)])
        runs = [r for r in runs if r[-1][1] - r[0][0] >= D.RUN]
        gone = [(x, y) for r in runs for x, y in r if min(places[b[x:y]]) != (i, x)]
        keep = bytes(c for k, c in enumerate(b) if not any(x <= k < y for x, y in gone))
        for x, y in gone:
            if removed and removed[-1][1] == x:
                removed[-1][1] = y
            else:
                removed.append([x, y])
        out.add((i, len(b), sum(map(len, runs)), len(b) - len(keep), len(removed), hashlib.sha256(keep).hexdigest()))
    return out


def test_against_brute_force(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9))) for _ in range(n))
    shared = [prose(n) for n in (60, 120, 300)]
    rows = [(0, None), (1, ""), (2, "x" * 5000), (3, "ab " * 400)] + [(i, prose(r.randrange(1, 80)) + r.choice(["", *shared]) + prose(9)) for i in range(4, 60)]
    rows += [(100 + i, t) for i, t in rows[4:8]]
    got = D.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept_text").collect()
    assert {tuple(x) for x in got} == brute(rows) and len(got) == len(rows)


def test_short_copies_go(spark):
    line = "One short line that many pages have."
    rows = [(i, line) for i in range(5)] + [(5, "tiny"), (6, "tiny"), (7, "another")]
    got = {x.doc_id: x for x in D.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(8)] == [0, *[len(line)] * 4, 0, 4, 0]
    assert [got[i].kept_text for i in range(1, 5)] == [""] * 4 and got[6].kept_text == ""
    assert got[0].n_repeated > 0 and got[5].n_repeated == 1 and got[7].n_repeated == 0


def test_insertion_moves_few_chunks():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, 20000).astype(np.uint8)
    b = np.concatenate((a[:5000], a[:3], a[5000:]))
    cut = lambda x: {x[s:e].tobytes() for s, e in zip([0, *D.ends(x, np.array([0, len(x)]))[1][:-1]], D.ends(x, np.array([0, len(x)]))[1])}
    assert len(cut(b) - cut(a)) <= 6


def test_empty_table(spark):
    assert D.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
