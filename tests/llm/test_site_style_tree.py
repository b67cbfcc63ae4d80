import math
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from tessera.llm import site_style_tree as T

PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{x:y}</style><script>var a="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></ul></nav><!-- <p>comment --><div class="cookie-notice">We use</div>
<div class="ad" id='x1'>Buy</div><main><article><header><h1>Title &amp; more</h1></header><p><b>First
 para&nbsp;graph.<br><p>Second <i>in</i>line.</p><form><label>Name</label><input></form><aside>side</aside><ul><li>One<li>Two</ul>
<div class="Comments"><p>reader</p></div><p hidden>gone</p><p>Last &lt;b&gt; &#233;&eacute; &bogus; &am</p></article></main>
<div role="contentinfo">foot</div><footer>&copy; x</footer></body></html>"""


def alone(html):
    """The text of a page of which no tree is known."""
    _, places, found = T.places(html)
    stay = set(T.important([(p["place"], p["up"], p["mark"], p["text"], T.PRIOR, 1.0) for p in places], T.LOW, T.NAMED))
    return " ".join(b["text"] for b in found if b["place"] in stay)


def test_one_page():
    assert alone(PAGE) == "Title & more First para graph. Second inline. One Two Last <b> éé &bogus; &am"


@pytest.mark.parametrize(
    ("html", "want"),
    [("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<div>a<b>b</b>c</div>d", "abc d"), ("<p>cut <b", "cut"), ("<article><p>open", "open"), ("a<!-- b", "a"), ("<script>x", ""), ("1 < 2 <3", "1 < 2 <3"), ("<table><tr><td>a<td>b<tr><td>c</table>d", "a b c d"), ("</p></div>x", "x"), ("<" * 50 + "p>", "<" * 49), ("<div>" * 3000 + "deep", "deep"), ("<article></article><p>t", "t"), ('<a title="a>b">l</a>', "l")],
)
def test_odd_markup(html, want):
    assert alone(html) == want


@pytest.mark.parametrize("html", ['<div class="layout no-sidebar"><article><p>story</p></article></div>', '<main class="with-sidebar"><p>story</p></main>', '<article class="post comments-open"><p>story</p></article>', '<article><p class="share-price">story</p></article>', '<div class="comments-open"><p>story</p></div>', '<aside><article>story</article></aside>'])
def test_names_that_say_nothing(html):
    assert alone(f"<nav>menu</nav>{html}<div class='ad-slot'>buy</div><div id=sidebar-left>x</div>") == "story"


def test_deep_elements_are_parsed():
    for n in (10, 60, 3000):
        deep, end = "<div>" * n, "</div>" * n
        assert alone(f"{deep}keep<nav>menu</nav><div class=comments><p>reader</div><p>on{end}") == "keep on"
        assert alone(f"<div><article>{deep}x{end}<p>rest</p></article></div>") == "x rest"
        assert alone(f"{deep}<article>a</article><nav>b</nav>{end}") == "a"
        assert alone(f"{deep}<ul><li>a<ul><li>b</ul><li>c <b>d</ul></b>e{end}") == "a b c d e"


def test_deep_pages_take_linear_time():
    n = 50000
    for html in ("<b>x" * n + "</i>" * n, "<u><div>" + "<b>" * n + "</u>x" * n, "<div>x" * n + "<li>" * n, "<p>" + "<b>" * n + "<i></i>x" * n):
        began = time.monotonic()
        alone(html)
        assert time.monotonic() - began < 20


class Dom(HTMLParser):
    """Tree of a page whose elements are all closed: lists [tag with class, children or texts]."""

    def __init__(self, html):
        super().__init__()
        self.top = ["root", []]
        self.open = [self.top]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        e = [tag + "".join(f" {k}={v}" for k, v in attrs if k == "class"), []]
        self.open[-1][1].append(e)
        self.open.append(e)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            self.open[-1][1].append(data.strip())


def brute(pages, names):
    """The text of each page (host, html) by the definitions; block elements and whole-text links only."""
    def walk(e, path):
        path = (*path, e[0])
        yield path, e
        for c in e[1]:
            if isinstance(c, list) and c[0] != "a":
                yield from walk(c, path)

    def texts(e):
        return [t for c in e[1] for t in ([c] if isinstance(c, str) else c[1] if c[0] == "a" else [])]

    def linked(e):
        if isinstance(e, str):
            return False
        here = [isinstance(c, list) and c[0] == "a" or linked(c) for c in e[1]]
        return bool(here) and all(here)

    def style(e):
        out = []
        for c in e[1]:
            name, k = ("#text", False) if isinstance(c, str) or c[0] == "a" else (c[0], linked(c))
            if out and out[-1][:2] == [name, k]:
                out[-1][2] += 1
            else:
                out.append([name, k, 1])
        return str([[n, k, 1 if k or n == "#text" else i] for n, k, i in out])

    def mark(path):
        for name in reversed(path):
            if name.split()[0] in ("article", "main"):
                return 1
            if name.split()[0] in ("nav", "footer", "aside", "form") or re.search("class=(ad|comments)$", name):
                return -1
        return 0

    entropy = lambda counts: -sum(n / sum(counts) * math.log(n / sum(counts)) for n in counts)

    def tree(htmls):
        m, styles, words = Counter(), defaultdict(Counter), defaultdict(Counter)
        for html in htmls:
            seen = defaultdict(lambda: (set(), set()))
            for path, e in walk(Dom(html).top, ()):
                seen[path][0].add(style(e))
                seen[path][1].update(texts(e))
            for path, (a, b) in seen.items():
                m[path] += 1
                styles[path].update(a)
                words[path].update(b)
        look = {p: entropy(styles[p].values()) / math.log(min(m[p], 32)) if m[p] > 1 else None for p in m}
        content = {p: 1 - sum(n * math.log(n) for n in words[p].values()) / sum(words[p].values()) / math.log(m[p]) if m[p] > 1 and words[p] else None for p in m}
        return m, look, content

    lean = lambda m, v, prior, w: prior if v is None else ((m - 1) * min(v, 1) + w * prior) / (m - 1 + w)
    am, al, ac = tree([h for _, h in pages])
    by = {host: tree([h for g, h in pages if g == host]) for host in {g for g, _ in pages}}
    out = []
    for host, html in pages:
        m, lk, ct = by[host]
        look, chosen = {}, []
        for path, e in walk(Dom(html).top, ()):
            every = lean(am[path], al[path], 0.8, 1)
            v = lean(m[path], lk[path], every, 4)
            if path[:-1] and not (names and mark(path) < 0 <= mark(path[:-1])):
                v = max(v, 0.9 * look[path[:-1]])
            look[path] = v
            every = lean(am[path], ac[path], 1.0, 1)
            chosen.append((e, 0.6 * v + 0.4 * min(lean(m[path], ct[path], every, 4), every) + names * mark(path)))
        best = max((v for e, v in chosen if texts(e)), default=0)
        least = 0.55 if best >= 0.55 else max(best - 0.05, 0.2)
        keep = {id(e) for e, v in chosen if v >= least}

        def flat(e, own):
            for c in e[1]:
                if isinstance(c, str):
                    yield c if own else None
                elif c[0] == "a":
                    yield from (t if own else None for t in c[1])
                else:
                    yield from flat(c, id(c) in keep)

        top = chosen[0][0]
        out.append(" ".join(t for t in flat(top, id(top) in keep) if t))
    return out


def site(r, i, unnamed):
    word = lambda: "".join(r.choice("abcdef") for _ in range(5))
    say = lambda n: " ".join(word() for _ in range(n))
    nav, ad, art, foot = ("div class=x", "div class=y", "div class=z", "div class=w") if unnamed else ("nav", "div class=ad", "article", "footer")
    tag = lambda t, inner: f"<{t}>{inner}</{t.split()[0]}>"
    body = tag(nav, "<ul>" + "".join(f"<li><a>{word()}</a></li>" for _ in range(r.randrange(3, 7))) + "</ul>") + tag(ad, say(6))
    body += tag(art, f"<h1>{say(3)}</h1>" + "".join(r.choice([f"<p>{say(8)}</p>"] * 4 + [f"<blockquote><p>{say(4)}</p></blockquote>"]) for _ in range(r.randrange(1, 9))))
    body += tag("div class=comments", "".join(f"<p>{say(3)}</p>" for _ in range(r.randrange(3)))) if i % 3 == 0 and not unnamed else ""
    return f"<html><body>{body}{tag(foot, 'All rights ' + word())}</body></html>"


def test_tree_against_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.com"] * 30 + ["b.com"] * 9 + ["c.com"] * 2 + ["d.com"] + ["e.com"] * 12
    pages = [(h, site(r, i, h == "e.com")) for i, h in enumerate(hosts)]
    df = spark.createDataFrame([(i, f"http://{h.upper()}/{i}", x) for i, (h, x) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    for names in (T.NAMED, 0.0):
        got = {x.page_id: x.text for x in T.extracted(df, names=names).collect()}
        assert [got[i] for i in range(len(pages))] == brute(pages, names)


def test_the_tree_decides(spark):
    """Without names nearly all pages come out the same; without the tree no boilerplate goes."""
    r = random.Random(5)
    pages = [(i, f"http://h{i % 4}.com/{i}", site(r, 1, False)) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    story = {i: " ".join(re.findall(r"<(?:h1|p)>(.*?)</", h)) for i, _, h in pages}
    text = lambda **kw: {x.page_id: x.text for x in T.extracted(df, **kw).collect()}
    assert text() == story
    unnamed = text(names=0.0)
    assert sum(unnamed[i] == story[i] for i in story) >= 55
    off = text(low=-1.0)
    assert all("All rights" in off[i] for i in off)


def test_rows_of_any_kind(spark):
    rows = [(1, "http://h/1", PAGE), (1, "http://h/1", PAGE), (None, "http://h/2", "<p>x</p>"), (3, None, None), (4, "x", ""), (5, "http://h/5", "long " * 300000)]
    df = spark.createDataFrame([(*r, "a", 7, True) for r in rows], "page_id long, url string, html string, host string, place int, text boolean")
    out = sorted(((x.page_id or 0, x.url or "", x.text, x.n_chars) for x in T.extracted(df).collect()))
    assert len(out) == 6 and out[0][2] == "x" and out[1] == out[2] and out[3][2:] == ("", 0) and out[4][2:] == ("", 0) and out[5][3] == 1499999
    assert all(n == len(t) for _, _, t, n in out)
    assert T.extracted(df.limit(0)).collect() == []
