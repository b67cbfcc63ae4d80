"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing names, for every query and stage."""

import corpus_pipeline
import pytest

from tessera.llm import queries

LONG = "Ein sehr langer Text, der sich nicht wiederholt: " + " ".join(f"wort{i}x{i * 7919 % 1009}" for i in range(40_000))
#: Names that the operators use themselves.
CLASH = ["n", "h", "at", "key", "digest", "sig", "bands", "component", "component_id", "n_shingles", "kept", "rep", "copies", "marks", "spans", "place", "ahead", "piece", "route", "start", "length", "host", "path", "low", "rule", "verdict", "first", "media", "own", "took", "count", "sha", "kept_text", "row_id", "hit", "items", "bytes", "_id", "_cut", "id", "labels", "score", "lang_pred", "offset"]
PAGE = "<html><body><nav>menu</nav><article><p>Some text of the page that is long enough to be a payload of over a hundred bytes in all.</p></article></body></html>"


def wide(rows, names):
    return [(*r, *(f"extra {k}" for k in range(len(CLASH)))) for r in rows], ", ".join([names, *(f"`{c}` string" for c in CLASH)])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = [(0, None, None, None, None), (None, "A text without an id, and no source.", None, "s", 3), (None, None, None, None, None), (1, "", "en", "s", 0), (2, LONG, "de", "s", len(LONG)), (3, LONG, None, None, None), (4, "Short text", "en", "s", 10), (4, "Short text", "en", "s", 10), (5, "\x00\x01 \U0001f600 ☃ ́", "fr", "s", 1), (6, "... 123 !!!", "en", "s", 9), (7, "the of and " * 900, "en", "s", 1), (-8, "negative id with some words in it", "en", "s", 1)]
    pages = [(0, None, None), (None, "http://a.com/x", PAGE), (1, "http://A.com/en/1", PAGE), (1, "http://A.com/en/1", PAGE), (2, "", ""), (3, "no scheme", "<p>" * 5000 + LONG), (4, "http://x.com/\r\n", "\x00<a"), (5, None, PAGE)]
    items = [("x", None), (None, "Some item without id of more than ten words for the test here"), ("y", ""), ("z", "some words in it"), ("z", "some words in it")]
    out = {}
    for kind in ("full", "empty"):
        d = tmp_path_factory.mktemp(kind)
        for name, rows, shape in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("pages", pages, "page_id long, url string, html string"), ("benchmark", items, "item_id string, text string")):
            data, names = wide(rows if kind == "full" else [], shape)
            spark.createDataFrame(data, names).repartition(3).write.parquet(f"{d}/{name}.parquet")
        out[kind] = (str(d), {"documents": len(docs), "pages": len(pages)} if kind == "full" else {"documents": 0, "pages": 0})
    return out


@pytest.mark.parametrize("kind", ["full", "empty"])
@pytest.mark.parametrize("name", queries.QUERIES)
def test_every_row_has_a_result(spark, tables, name, kind):
    d, n = tables[kind]
    got = queries.QUERIES[name](spark, d).collect()
    table = "pages" if name.split("_")[0] in ("op1", "op2", "op8") else "documents"
    if name.startswith("op6"):
        assert len({(r.doc_id, r.piece, r.ids_crc32) for r in got if r.doc_id is not None}) >= (9 if kind == "full" else 0)
        assert sum(r.piece == 0 for r in got) == n[table]
    else:
        assert len(got) == n[table]


@pytest.mark.parametrize("kind", ["full", "empty"])
def test_stages(spark, tables, kind):
    d, n = tables[kind]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, d)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) <= n["documents"] and (kind == "empty" or rows or name == "language_id")
        if name in ("substring_dedup", "decontaminate"):
            assert len(rows) == n["documents"]
            keep = {(r.doc_id, r.text) for r in rows if r.doc_id in (0, None, 1, 4)}
            assert kind == "empty" or keep == {(0, None), (None, "A text without an id, and no source."), (None, None), (1, ""), (4, "Short text")}
    assert (kind == "empty") == (corpus_pipeline.run(spark, d).count() == 0)


def test_results_of_edge_rows(spark, tables):
    d, _ = tables["full"]
    of = lambda name: {r.doc_id: r for r in queries.QUERIES[name](spark, d).collect()}
    near = of("op10_minhash_near_dedup")
    assert (near[0].n_shingles, near[0].component_id, near[0].kept) == (0, 0, True) and near[3].component_id == 2 and not near[None].kept
    cut = of("op9_suffix_array_dedup")
    assert cut[2].n_removed == cut[3].n_removed == len(LONG.encode()) and cut[4].n_removed == 0 and cut[7].n_removed > 9000
    bench = of("op4_benchmark_decontamination")
    assert bench[-8].n_hit == 4 and bench[-8].n_items == 1 and bench[0].n_words == 0
    lang = of("op5_language_id")
    assert lang[6].lang_pred == lang[0].lang_pred == lang[1].lang_pred == "und" and not lang[None].held_out
