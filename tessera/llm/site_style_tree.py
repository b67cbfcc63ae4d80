"""Main text of web pages by a site style tree.

1. Each page is parsed once into a tree of elements. An element's name is its tag with class
   and id (digits out), its place the path of names from the root. Its presentation style is the
   sequence of its children with the length of each run; a run of children whose text is
   all in links counts as one, so that a menu looks alike whatever its number of entries.
2. The trees of all pages of a host are merged: for each place, on how many pages it stands, its
   styles there and the text blocks that stand directly in it. Counts are kept by (host, place,
   feature) with partial aggregation, so a host of any size is spread over all tasks. The same
   counts over all hosts make the tree of the corpus.
3. Presentation importance of a place: the entropy of its styles over its pages, to a base of the number
   of these pages, BASE at most. It is 0 if all pages look alike there. A branch in a varied branch is part of
   it: it has at least INHERIT times what its parent has. Content importance: 1 less the mean entropy of
   the place's blocks over the pages, 0 if the same blocks stand on every page and 1 if each stands on one;
   the less of the host's and the corpus's. A host with few pages
   leans on the corpus (HOST_WEIGHT pages), the corpus on PRIOR (one page).
4. Importance = PRESENTATION * the one + (1 - PRESENTATION) * the other + NAMED * what names say. The names
   (tags, roles, whole class words by their last part) are one feature of a node: 1 in an article, -1 in a menu, advert or comment
   section, 0 elsewhere; the nearest named ancestor counts, and a branch named -1 doesn't inherit its
   parent's presentation. NAMED is less than 1 - LOW: names alone remove nothing from a tree of full importance.
5. Text of places with an importance under LOW is removed. Where a page has no place that reaches LOW,
   those with its highest importance (within NEAR, above LEAST) stay.

Reader comments vary from page to page as an article does; the tree holds them for content, and it takes the
names besides to let them go. A lone page has no tree but PRIOR, so there the names decide.

Text: character references are decoded, white space in a block becomes one space, blocks are
trimmed and joined in page order by one space. What browsers don't show (scripts, styles, controls, hidden
elements) has no text. Null html gives an empty text. A null url has the empty host. Rows that repeat, and
rows with a null page_id, each get their own result; other columns are ignored. Unclosed, misnested and cut-off markup is read as browsers
do in the main: what is open at the end is closed there. Elements of any depth have a place.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C
from .url_filter import host_of

LOW, PRESENTATION, NAMED = 0.55, 0.6, 0.44
BASE, INHERIT, HOST_WEIGHT, PRIOR = 32, 0.9, 4, 0.8
NEAR, LEAST = 0.05, 0.2

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "optgroup": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
#: Never shown as text.
MUTE = frozenset("head script style noscript template iframe svg canvas math object embed applet audio video map button select textarea input datalist frameset noframes noembed title xmp".split())
#: Names that page authors give to what is no article (-1), and to articles (1).
BESIDE = frozenset("nav footer aside form dialog menu search".split())
BESIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status note".split())
BESIDE_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts "
    "popup popups modal overlay lightbox nav navs navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidebars aside rail footer footers bottombar masthead topbar toolbar "
    "comment comments commentlist disqus discussion reply replies respond sharing social subscribe subscription newsletter signup login signin register form forms searchbox related recommended recommendations widget widgets pagination pager".split()
)
HEADER_NAMED = frozenset("header headers".split())
MAIN = frozenset(("article", "main"))
#: A class word that begins so says that the thing is absent, or about the page's layout.
ABOUT = frozenset("no not non without with has have is hide".split())
#: What may follow a name in a class word.
PART = frozenset("left right top bottom main primary secondary container wrapper wrap box slot unit block list body item items area section content inner outer bar bars links link text title label first last".split())

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPLIT_NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")


class Node:
    """An element: place is a hash of its path, parent the nearest element that text belongs to, mute if it isn't shown, mark what names say.

    block and solid are the depths of the nearest node, itself included, that text belongs to and that isn't inline.
    """

    __slots__ = ("tag", "name", "parent", "place", "mute", "mark", "linked", "depth", "block", "solid", "children", "chars", "in_links")

    def __init__(self, tag: str, name: str, up: Node | None, parent: Node | None, mute: bool, mark: int | None) -> None:
        self.tag, self.name, self.parent, self.mute = tag, name, parent, mute or up is not None and up.mute
        self.mark = mark if mark is not None else up.mark if up else 0
        self.linked = tag == "a" or up is not None and up.linked
        self.depth = up.depth + 1 if up else 0
        inline = up is not None and tag in INLINE
        self.block = up.block if inline and not mute and mark is None else self.depth
        self.solid = up.solid if inline else self.depth
        #: Children that text can belong to, and None for each text block between them.
        self.children: list[Node | None] = []
        self.chars = self.in_links = 0
        self.place = _hash(f"{parent.place if parent else ''}/{name}") if self.block == self.depth else 0


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def marked(words: list[str], within_main: bool) -> bool:
    """Whether the words of one class or id name something beside the article."""
    if not words or words[0] in ABOUT:
        return False
    names = BESIDE_NAMED if within_main else BESIDE_NAMED | HEADER_NAMED
    return words[-1] in names or words[0] in names and all(w in PART for w in words[1:])


def named(tag: str, raw: str, within_main: bool) -> tuple[str, bool, int | None]:
    """(name, mute, mark) of a start tag with these attributes; mark is None if its names say nothing."""
    beside = tag in BESIDE or tag == "header" and not within_main
    if not raw or "=" not in raw and "hidden" not in raw:
        return tag, tag in MUTE, 1 if tag in MAIN else -1 if beside else None
    got: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        got.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    role = got.get("role", "").lower()
    mute = tag in MUTE or "hidden" in got or got.get("aria-hidden", "") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")))
    marks = f"{got.get('class', '')} {got.get('id', '')}".split()
    if tag in MAIN or role in ("main", "article") or got.get("itemprop", "").lower() == "articlebody":
        mark = 1
    elif beside or role in BESIDE_ROLE or tag not in ("body", "html") and any(marked([w.lower() for w in SPLIT_NAME.split(x) if w], within_main) for x in marks):
        mark = -1
    else:
        mark = None
    return DIGITS.sub("", f"{tag}.{got.get('class', '')}#{got.get('id', '')}") if marks else tag, mute, mark


def blocks(text: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The text blocks of a page with the node each belongs to, in page order, and all nodes that text can belong to."""
    root = Node("#root", "#root", None, None, False, 0)
    # A node's place in open_ is its depth; spots has those of each tag, so that no step walks down a deep page.
    open_, nodes, found, held = [root], [root], [], []
    spots: dict[str, list[int]] = defaultdict(list)
    where: Node | None = None
    links = 0

    def flush() -> None:
        nonlocal where, links
        if held:
            words = " ".join("".join(held).split())
            if words and where is not None and not where.mute:
                found.append((where, words))
                where.chars += len(words)
                where.in_links += min(links, len(words))
                if not where.children or where.children[-1] is not None:
                    where.children.append(None)
            held.clear()
        where, links = None, 0

    def add(piece: str) -> None:
        nonlocal where, links
        if piece:
            if where is None:
                where = open_[open_[-1].block]
            held.append(entities.unescape(piece) if "&" in piece else piece)
            if open_[-1].linked:
                links += len(held[-1])

    def close(k: int) -> None:
        """Close the open elements from the k-th on."""
        if any(n.block == n.depth for n in open_[k:]):
            flush()
        for n in open_[k:]:
            spots[n.tag].pop()
        del open_[k:]

    at = 0
    while at < len(text):
        m = TOKEN.search(text, at)
        if not m:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                add(" ")
                continue
            if spots[tag] and (tag not in INLINE or spots[tag][-1] > open_[-1].solid):
                close(spots[tag][-1])
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in ("br", "wbr"):
            add(" " if tag == "br" else "")
            continue
        if tag in ("html", "body") and spots[tag]:
            continue
        if tag in CLOSES_P and open_[open_[-1].solid].tag == "p":
            close(open_[-1].solid)
        if tag == "body" and spots["head"]:
            close(spots["head"][-1])
        if tag in CLOSES:
            scope = max((spots[t][-1] for t in SCOPE[tag] if spots[t]), default=0)
            inside = [spots[t][bisect_right(spots[t], scope)] for t in CLOSES[tag] if spots[t] and spots[t][-1] > scope]
            if inside:
                close(min(inside))
        up = open_[-1]
        raw = m[3] or ""
        name, mute, mark = named(tag, raw, up.mark > 0)
        if tag not in INLINE or mute or mark is not None:
            flush()
        if tag in VOID:
            continue
        parent = open_[up.block]
        node = Node(tag, name, up, parent, mute, mark)
        if node.block == node.depth and not node.mute:
            parent.children.append(node)
            nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if raw.rstrip().endswith("/") and tag in ("path", "rect", "circle", "use", "g", "line"):
            continue
        spots[tag].append(node.depth)
        open_.append(node)
    flush()
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.in_links += n.in_links
    return found, nodes


def style(n: Node) -> str:
    """The sequence of children, with run lengths; a run of children whose text is all in links is one."""
    runs: list[list] = []
    for c in n.children:
        links = c is not None and c.chars > 0 and c.in_links >= c.chars
        name = "#text" if c is None else c.name
        if runs and runs[-1][0] == name and runs[-1][1] == links:
            runs[-1][2] += 1
        else:
            runs.append([name, links, 1])
    return "|".join(f"{name}~" if links else f"{name}*{k}" for name, links, k in runs)


PARSED = "host string, page_id {}, url string, shape long, places array<struct<place: long, up: int, mark: int, text: boolean, features: array<struct<kind: int, feature: long>>>>, blocks array<struct<place: long, text: string>>"
_FEATURES = pa.list_(pa.struct([("kind", pa.int32()), ("feature", pa.int64())]))
_PLACES = pa.list_(pa.struct([("place", pa.int64()), ("up", pa.int32()), ("mark", pa.int32()), ("text", pa.bool_()), ("features", _FEATURES)]))
_BLOCKS = pa.list_(pa.struct([("place", pa.int64()), ("text", pa.string())]))


def places(text: str) -> tuple[int, list[dict], list[dict]]:
    """(shape, places, blocks) of a page. Places stand after those they are in; up is where, -1 for the root.

    Features: (0, 0) once, (1, a style) and (2, a block) for each that the place has on the page. The shape is a hash of all places and of
    which have text.
    """
    found, nodes = blocks(text)
    spot: dict[int, int] = {}
    out: list[dict] = []
    had: list[set] = []
    for n in nodes:
        if n.place not in spot:
            spot[n.place] = len(out)
            out.append({"place": n.place, "up": spot[n.parent.place] if n.parent else -1, "mark": n.mark, "text": False})
            had.append({(0, 0)})
        had[spot[n.place]].add((1, _hash(style(n))))
    for n, t in found:
        out[spot[n.place]]["text"] = True
        had[spot[n.place]].add((2, _hash(t)))
    for p, h in zip(out, had, strict=True):
        p["features"] = [{"kind": k, "feature": f} for k, f in sorted(h)]
    shape = _hash(" ".join(f"{p['place']}{'+' if p['text'] else ''}" for p in out))
    return shape, out, [{"place": n.place, "text": t} for n, t in found]


def parsed(pages: DataFrame) -> DataFrame:
    """PARSED of every row of pages (host, page_id, url, html), each parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in C.slices(batches, "html"):
            got = [places(t or "") for t in batch.column("html").to_pylist()]
            cols = [batch.column("host"), batch.column("page_id"), batch.column("url"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], _PLACES), pa.array([g[2] for g in got], _BLOCKS)]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "page_id", "url", "shape", "places", "blocks"])

    return pages.select("host", "page_id", "url", "html").mapInArrow(run, PARSED.format(dict(pages.dtypes)["page_id"]))


def _tree(met: DataFrame, by: list[str]) -> DataFrame:
    """(by, m, look, content): pages and unsmoothed importances of each place of the trees of by, null where one page has it."""
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    n, m = F.col("n").cast("double"), F.col("m")
    node = met.groupBy(*by).agg(of(0, F.col("n")).alias("m"), of(1, n * F.log(n)).alias("s"), of(1, n).alias("styles"), of(2, n * F.log(n)).alias("b"), of(2, n).alias("blocks"))
    # With p = n / m: -sum(p log p) = log m - sum(n log n) / m.
    look = F.when(m > 1, F.least(F.lit(1.0), (F.log("styles") - F.col("s") / F.col("styles")) / F.log(F.least(m, F.lit(BASE)).cast("double"))))
    content = F.when((m > 1) & (F.col("blocks") > 0), 1 - F.col("b") / F.col("blocks") / F.log(m.cast("double")))
    return node.select(*by, "m", look.alias("look"), content.alias("content"))


def _leaning(m: Column, value: Column, prior: Column, weight: float) -> Column:
    """value, seen on m pages, and prior, which counts as much as weight further pages."""
    return F.when(value.isNull(), prior).otherwise(((m - 1) * value + weight * prior) / (m - 1 + weight))


def importance(rows: DataFrame) -> DataFrame:
    """(host, place, m, look, content) of every place of every host's tree, from rows (host, place, kind, feature)."""
    met = C.kept(rows.groupBy("host", "place", "kind", "feature").agg(F.count(F.lit(1)).alias("n")))
    corpus = _tree(met.groupBy("place", "kind", "feature").agg(F.sum("n").alias("n")), ["place"])
    corpus = corpus.select("place", _leaning(F.col("m"), F.col("look"), F.lit(PRIOR), 1).alias("all_look"), _leaning(F.col("m"), F.col("content"), F.lit(1.0), 1).alias("all_content"))
    both = _tree(met, ["host", "place"]).join(C.kept(corpus), "place")
    content = F.least(_leaning(F.col("m"), F.col("content"), F.col("all_content"), HOST_WEIGHT), F.col("all_content"))
    return both.select("host", "place", "m", _leaning(F.col("m"), F.col("look"), F.col("all_look"), HOST_WEIGHT).alias("look"), content.alias("content"))


def important(page: list[tuple], low: float, names: float) -> list[int]:
    """The places of a page whose text stays; page has (place, up, mark, text, look, content), places after those they are in."""
    looks: list[float] = []
    value: dict[int, float] = {}
    for place, up, mark, text, look, content in page:
        if up >= 0 and not (names and mark < 0 <= page[up][2]):
            look = max(look, INHERIT * looks[up])
        looks.append(look)
        if text:
            value[place] = PRESENTATION * look + (1 - PRESENTATION) * content + names * mark
    if not value:
        return []
    best = max(value.values())
    least = low if best >= low else max(best - NEAR, LEAST)
    return [p for p, v in value.items() if v >= least]


def extracted(pages: DataFrame, low: float = LOW, names: float = NAMED) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html).

    With low=-1 the tree decides nothing, with names=0 the names do not.
    """
    with C.small_batches(pages.sparkSession), C.scope() as needed:
        url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
        all_ = needed(C.kept(parsed(pages.select(host_of(url).alias("host"), "page_id", url.alias("url"), html.alias("html")))))
        place = all_.select("host", F.explode("places").alias("p")).select("host", "p.place", F.explode("p.features").alias("f")).select("host", "place", "f.kind", "f.feature")
        tree = C.kept(importance(place))
        slim = F.transform("places", lambda p: F.struct(p["place"].alias("place"), p["up"].alias("up"), p["mark"].alias("mark"), p["text"].alias("text"))).alias("places")
        shapes = all_.select("host", "shape", slim).groupBy("host", "shape").agg(F.any_value("places").alias("places"))
        each = shapes.select("host", "shape", F.posexplode("places").alias("k", "p")).select("host", "shape", "k", "p.*").join(tree.select("host", "place", "look", "content"), ["host", "place"])
        # A group is a page's places.
        whole = each.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("k", "place", "up", "mark", "text", "look", "content"))).alias("page"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = [important([(p["place"], p["up"], p["mark"], p["text"], p["look"], p["content"]) for p in page], low, names) for page in batch.column("page").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("shape"), pa.array(stay, pa.list_(pa.int64()))], names=["host", "shape", "stay"])

        stay = needed(C.kept(whole.mapInArrow(run, "host string, shape long, stay array<long>")))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("stay", b["place"])), lambda b: b["text"]), " ").alias("text")
    return all_.drop("places").join(stay, ["host", "shape"]).select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("long"))
