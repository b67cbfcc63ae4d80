import random
import zlib

import corpus_pipeline as P
import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

from .test_fm_index import words
from .test_langid import BITS, prose
from .test_minhash import brute as near_brute


def without_repeats(rows, length=200):
    from collections import Counter

    met = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if met[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")))
    return out


def without_items(text, items):
    import re

    raw = text.encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)]
    w = words(text)
    hit = [False] * len(w)
    for t in items:
        v = words(t)
        for a in range(max(1, len(v) - 9) if v else 0):
            p = v[a : a + 10]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit[k : k + len(p)] = [True] * len(p)
    cut, occ = np.zeros(len(raw), bool), []
    for t in items:
        v = words(t)
        for a in range(max(1, len(v) - 9) if v else 0):
            p = v[a : a + 10]
            occ += [(k, k + len(p)) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    merged = []
    for a, b in sorted(occ):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        cut[spans[a][0] : spans[b - 1][1]] = True
    return bytes(x for x, c in zip(raw, cut) if not c).decode()


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    r = random.Random(9)
    items = [(i, prose(r, "en", 20)) for i in range(4)]
    shared = prose(r, "de", 60)
    rows = [(0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "123 456", "de", "s", 7)]
    for i in range(3, 150):
        lang = r.choice(list(BITS))
        t = prose(r, lang, r.choice([3, 30, 120]))
        if r.random() < 0.2:
            t += " " + shared + " " + prose(r, lang, 9)
        if r.random() < 0.2:
            t += ". " + r.choice(items)[1] + ", " + prose(r, lang, 9)
        rows.append((i, t, lang, "s", len(t)))
    rows += [(i + 1000, t, lang, s, n) for i, t, lang, s, n in rows[3:30]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, [t for _, t in items]


def test_against_brute_force(spark, corpus):
    d, rows, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = P.language_id(spark, docs, d)
    assert first.columns == docs.columns
    kept = {r.doc_id: r.text for r in first.collect()}
    assert not {0, 1, 2} & kept.keys() and len(kept) >= len(rows) - 6
    ids = {i for i, _, _, good in near_brute(sorted(kept.items())) if good}
    texts = without_repeats([(i, kept[i].encode()) for i in sorted(ids)])
    texts = {i: without_items(t, items) for i, t in texts}
    T = Tokenizer.from_file(packing.VOCABULARY)
    want = set()
    for i, t in texts.items():
        x = [*T.encode(t, add_special_tokens=False).ids, 0]
        want |= {(i, k // 2048, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for k in range(0, len(x), 2048)}
    got = P.run(spark, d).collect()
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, corpus):
    d, _, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0


def test_near_copies_from_four_fifths_on_go(spark):
    r = random.Random(4)
    rows = []
    for g in range(20):
        w = [f"w{g}x{k}" for k in range(100)]
        rows.append((2 * g, " ".join(w)))
        # k words in the middle changed: 96 - (k + 4) shingles of 96 stay on either side.
        k = r.choice([3, 4, 5, 6, 7])
        rows.append((2 * g + 1, " ".join(w[:50] + [f"n{g}x{j}" for j in range(k)] + w[50 + k :])))
    want = {i for i, _, _, good in near_brute(rows, 80) if good}
    assert want < {i for i, _, _, good in near_brute(rows) if good}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in P.near_dedup(spark, docs, "").collect()} == want


def test_rows_without_an_id_are_judged_by_their_language(spark, corpus):
    d, rows, _ = corpus
    more = [(None, t, lang, s, n) for _, t, lang, s, n in rows[:30]]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long")
    score = P.langid.identify(docs).where("doc_id is not null").collect()
    good = {x.doc_id for x in score if x.lang_pred != P.langid.UNKNOWN and x.score >= P.LEAST_SCORE}
    got = P.language_id(spark, docs, d)
    want = [x for x in rows if x[0] in good] + [m for m, x in zip(more, rows) if x[0] in good]
    assert got.schema == docs.schema and len(want) > len(good) > 0
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_near_dedup_of_rows_of_any_kind(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base, "a"), (5, base, "a"), (3, base + " x", "b"), (None, base, "c"), (None, base, "c"), (None, None, None), (7, None, "d"), (8, "", "e"), (9, "alone here", "f"), (9, "other text", "g"), (4, "t " * 100000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = P.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    want = [r for r in rows if r[0] != 5]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
