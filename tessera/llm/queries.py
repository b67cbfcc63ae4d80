"""The queries opN_<name>, each an operator of this subpackage over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cdc, fm_index, langid, media, minhash, packing, site_style_tree, suffix_dedup, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style_tree.extracted(_table(spark, sf_dir, "pages"))


def op3_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_bytes, n_repeated (chunks), n_removed (bytes), n_spans, kept_sha256."""
    return cdc.deduplicated(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_media_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(_table(spark, sf_dir, "documents")))


#: Of op8, as its contract states them.
URL_RULES = [
    url_filter.Rule("com", "/en/", "block"),
    url_filter.Rule("example.com", "/en/7", "allow"),
    url_filter.Rule("net", "/de/", "block"),
    url_filter.Rule("example.net", "/de/8", "block"),
    url_filter.Rule("org", "/es/", "block"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_salvage, op2_site_style_tree, op3_content_defined_chunks, op4_benchmark_decontamination, op5_language_id, op6_best_fit_packing, op7_media_signatures, op8_url_filter, op9_suffix_array_dedup, op10_minhash_near_dedup)}

_URL = r"""
    with p as (
        select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
        from pages
    ), r(h, p, v) as (values {rules}),
    f as (
        select *, (select max((length(h || p), length(h), h || p, v)) from (select h, r.p, v from r) as x where (host = h or ends_with(host, '.' || h)) and starts_with(path, x.p)) as best
        from p
    )
"""

_WARC = """
    with p as (select page_id, encode(coalesce(html, '')) as b from pages),
    d as (select page_id, octet_length(b) as n, sha256(b) as h from p),
    f as (select *, case when n >= 100 then min(page_id) over (partition by h) end as first from d)
    select page_id, n as payload_bytes, h as payload_digest,
        case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
        case when first is not null and page_id is distinct from first then first end as refers_to
    from f
"""

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH = f"""
    with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
    b as (select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where item_id is not null),
    p as (select distinct item, least(len(w), 10) as n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
    g as (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from p) where len(w) >= n)),
    m as (select g.doc_id, g.k, g.n, p.item from g join p using (g, n)),
    h as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(k, k + n)) as spot from (select distinct doc_id, k, n from m)) group by 1),
    i as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct doc_id, item from m) group by 1)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join h using (doc_id) left join i using (doc_id)
"""

_REPEATS = """
    with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
    w as (select doc_id, k, n, md5(x[2 * k + 1 : 2 * k + 400]) as g from (select *, unnest(range(0, n - 199)) as k from d where n >= 200)),
    m as (select doc_id, k from w where g in (select g from w group by g having count(*) > 1)),
    s as (select doc_id, k, coalesce(k - lag(k) over (partition by doc_id order by k) > 200, true) as first from m),
    t as (select doc_id, k, sum(first::int) over (partition by doc_id order by k) as run from s),
    r as (select doc_id, run, min(k) as a, max(k) + 200 as b from t group by all),
    c as (select doc_id, run, b as a, coalesce(lead(a) over (partition by doc_id order by a), 1000000000) as b from r union all select doc_id, 0, 0, min(a) from r group by 1),
    k as (select c.doc_id, sha256(unhex(string_agg(x[2 * c.a + 1 : 2 * c.b], '' order by c.run))) as h from c join d using (doc_id) group by 1)
    select doc_id, n as n_bytes, coalesce((select sum(b - a) from r where r.doc_id = d.doc_id), 0)::bigint as n_removed, (select count(*) from r where r.doc_id = d.doc_id) as n_spans, coalesce(h, sha256(unhex(x))) as kept_sha256
    from d left join k using (doc_id)
"""

_NEAR = f"""
    with recursive d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select distinct doc_id, array_to_string(w[k : k + 4], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    e as (select i, j from (select a.doc_id as i, b.doc_id as j, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2) join n x on x.doc_id = i join n y on y.doc_id = j where 100 * c >= 85 * (x.n + y.n - c)),
    r as (select doc_id as i, doc_id as c from d union select e.j, r.c from r join e on e.i = r.i where e.j > r.c),
    low as (select i, min(c) as c from r group by 1)
    select doc_id, coalesce(n, 0) as n_shingles, c as component_id, doc_id = c as kept from d left join n using (doc_id) join low on i = doc_id
"""

SQL: dict[str, str] = {
    "op4_benchmark_decontamination": _BENCH,
    "op9_suffix_array_dedup": _REPEATS,
    "op10_minhash_near_dedup": _NEAR,
    "op1_warc_salvage": _WARC,
    "op8_url_filter": _URL.format(rules=", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)) + "select page_id, host, path, best[3] as rule, coalesce(best[4], 'allow') as verdict from f",
}
