import random
import re

import pytest

from tessera.llm import url_filter as U

RULES = [U.Rule("com", "/en/", "block"), U.Rule("example.com", "/en/7", "allow"), U.Rule("net", "/de/", "allow"), U.Rule("Example.net", "/de/8", "block"), U.Rule("b.com", "", "block"), U.Rule("a.b.com", "/x", "allow"), U.Rule("x.b.com", "/x", "block"), U.Rule("ab.com", "/", "block"), U.Rule("", "/", "block")]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def brute(rows, rules, default="allow"):
    out = []
    for i, u in rows:
        h, p = parts(u)
        fit = [r for r in rules if r.host and (h == r.host.lower() or h.endswith("." + r.host.lower())) and p.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "allow"), default=None)
        out.append((i, h, p, best and best.host.lower() + best.path, best.verdict if best else default))
    return sorted(map(repr, out))


@pytest.mark.parametrize("most", [100, 2])
def test_against_brute_force(spark, most):
    r = random.Random(1)
    rows = [(0, None), (1, ""), (2, "no scheme.com/en/"), (3, "http://"), (4, "://com/en/"), (5, "a\n://b.com\n/x"), (None, "http://b.com")]
    hosts = ["com", "b.com", "ab.com", "a.b.com", "xa.b.com", "z.a.b.com", "b.com.", ".com", "EXAMPLE.com", "w.example.net", "é.com", "b-c.com", "0.com", "bb.com"]
    rows += [(r.randrange(60), f"{r.choice(['http', 'HTTPS', ''])}://{r.choice(hosts)}{r.choice(['', '/', '/en/7', '/en/', '/en', '/de/8x', '/x/y', '?/en/', '#q'])}{r.choice(['', '?a://b.com/x', '#t', '9'])}") for _ in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    assert sorted(repr(tuple(x)) for x in U.judged(df, RULES, most=most).collect()) == brute(rows, RULES)


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [tuple(x) for x in U.judged(df, []).collect()] == [(1, "a", "/b", None, "allow")]
    assert U.judged(df.limit(0), RULES).collect() == []
