import random
import re

import numpy as np

from tessera.llm import common as C, minhash as M


def brute(rows, percent=85):
    sets, low = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        low[i] = i
    def root(i):
        while low[i] != i:
            i = low[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and root(a) != root(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    low[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def rows(seed, groups, copies):
    r = random.Random(seed)
    out, i = [(0, None), (1, ""), (2, "  \t\n"), (3, "One two"), (4, "oNE TWO"), (5, "é É x y z w")], 10
    for _ in range(groups):
        base = [r.choice("ab cde fg hij kl mno pqr ßé".split()) + str(r.randrange(300)) for _ in range(r.choice([4, 5, 60, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            out.append((i, " ".join(w).upper() if r.random() < 0.1 else " ".join(w)))
            i += 1
    return out


def run(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return {tuple(x) for x in M.near_duplicates(df).collect()}


def test_against_brute_force(spark):
    data = rows(1, 12, 6)
    assert run(spark, data) == brute(data)


def test_banding():
    assert M.banding(85) == (32, 6) and M.banding(80) == (38, 5)
    for percent in range(10, 101, 5):
        bands, rows = M.banding(percent)
        assert bands * rows <= M.MINIMA and (1 - (percent / 100) ** rows) ** bands <= M.MISS


def test_large_groups_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    monkeypatch.setattr(M, "LOT", 2)
    data = rows(2, 2, 50)
    assert run(spark, data) == brute(data)


def test_slices_without_a_shingle(spark):
    data = [(i, None if i % 2 else " ") for i in range(9)] + [(9, "a b c d e f")]
    assert run(spark, data) == brute(data)
    assert run(spark, data[:9]) == brute(data[:9])


def test_empty_table(spark):
    assert run(spark, []) == set()


def test_a_common_template_brings_no_pairs_together(spark, monkeypatch):
    """All documents share 85 % of their words, so every bucket is crowded; only few are linked."""
    monkeypatch.setattr(M, "BLOCK", 16)
    r = random.Random(5)
    template = [f"t{k}" for k in range(200)]
    own = lambda i: [f"x{i}_{k}" for k in range(36)]
    data = [(i, " ".join(template + own(i))) for i in range(120)]
    data += [(200 + i, " ".join(template + own(i) + ["more"])) for i in range(0, 120, 7)]
    for i in range(500, 540):
        w = template + own(i % 5)
        w[r.randrange(len(w))] = f"n{i}"
        data.append((i, " ".join(w)))
    units = []
    across = M.across
    monkeypatch.setattr(M, "across", lambda *a: (u := C.kept(across(*a)), units.append(u.count()))[0])
    assert run(spark, data[:120]) == brute(data[:120]) and units == [0]
    assert run(spark, data) == brute(data) and units[1] > 0


def test_rows_that_share_a_doc_id(spark):
    base = " ".join(f"w{k}" for k in range(50))
    data = [(1, base), (1, base), (2, base + " x"), (3, "other text"), (3, base + " y"), (None, base), (None, None), (4, None), (4, None)]
    df = spark.createDataFrame([(*x, 7, "k") for x in data], "doc_id long, text string, component long, key string")
    got = M.near_duplicates(df).collect()
    assert len(got) == len(data)
    assert {(x.component_id, x.kept) for x in got if x.doc_id is None} == {(None, False)}
    assert {tuple(x) for x in got if x.doc_id in (1, 2, 4)} == {(1, 46, 1, True), (2, 47, 1, False), (4, 0, 4, True)}
    assert all(x.component_id in (1, 3) for x in got if x.doc_id == 3)


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_words_are_compared_by_their_bytes(spark, monkeypatch):
    one = thue_morse(1024)
    two = one.translate({97: "b", 98: "a"})
    data = [(1, one), (2, two), (3, f"p q r s {one} t u v"), (4, f"p q r s {two} t u v"), (5, f"p q r s {two} t u v"), (6, two + " ")]
    assert run(spark, data) == brute(data)
    # Even if all hashes of words of one length agreed, sets are exact.
    monkeypatch.setattr(C.Prefixes, "spans", lambda self, start, end: (end - start).astype(np.uint64))
    texts = [b"ab cd ef gh ij kl", b"ab cd ef gh ij kl", b"zz cd ef gh ij kl", b"ab", b"zz"]
    sets = M.exact_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert [[len(np.intersect1d(a, b)) for b in sets] for a in sets] == [[2, 2, 1, 0, 0], [2, 2, 1, 0, 0], [1, 1, 2, 0, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1]]
