"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node that is content or not. A node's own features (its tag, the words of its class and id, how much text it has and how
much of that is links) give its potential; a table per kind of parent and child gives theirs. Messages sent from the leaves to the root and back
(sum-product) yield every node's marginal, and the text of nodes that are more likely content than not is the page's main text.

Both potentials are counted on labelled pages: a bounded sample of pages whose ``article`` or ``main`` element shows what is content, and the small pages of
SEEDS, labelled by hand, for layouts without it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import schema

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[a-z]+")
#: Left out up to their end tag, or to the end of the page: what they hold is no markup, or is not shown.
SKIPPED = frozenset("script style noscript template iframe title textarea".split())
FOREIGN = frozenset("svg math".split())
#: Text in them belongs to the block around them, parted from the words beside them.
EMBEDDED = FOREIGN | frozenset("object canvas audio video".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
ROOT = frozenset("html body".split())
SIDE = frozenset("nav header footer aside form fieldset menu dialog button label legend select".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption caption summary address".split())
BOXES = frozenset("div section main article td th ul ol dl table tbody thead tfoot tr figure details center head frameset hgroup".split())
BLOCKS = ROOT | SIDE | TEXTUAL | BOXES
#: Names of classes and ids that pages use for what is not their text, and for what is.
OUTSIDE = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus feedback footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget".split())
INSIDE = frozenset("article body content entry main post story text".split())
#: What a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Features of a node are not independent: each counts for a part of its log odds, what the author named a block for more than how its text looks.
PARTS = {"name": 1.0, "hidden": 1.0, "tag": 0.5}
TEXT_PART = 0.25

SEEDS = (
    '<body><div id="top"><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></div><div class="post" data-content><h2>The old mill</h2><p>The mill stood by the river for two hundred years, and nobody could say who had built it.</p><p>Short one.</p><ul><li>first it ground corn,</li><li>then it sawed wood.</li></ul></div><div class="comments"><h3>Comments</h3><p>What a lovely story, thank you for writing it down for all of us to read.</p><p>I disagree.</p></div><div id="footer"><p>All rights reserved by the owners of this site.</p></div></body>',
    '<body><header><h1>Daily Paper</h1><nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></nav></header><main data-content><h1>Rain in the hills</h1><p>It rained for three days, so the road to the pass was closed on Monday.</p><blockquote>Nobody was hurt, said the mayor, and the road will be open again soon.</blockquote><p>More to come.</p></main><aside><h2>Most read</h2><ul><li><a href="/1">Ten hills to climb this year</a></li><li><a href="/2">A pass reopens</a></li></ul></aside><footer><p>About us, imprint and privacy.</p></footer></body>',
    '<body><div class="cookie-notice"><p>We use cookies to make this site better. By reading on you agree to that.</p><button>Accept</button></div><table><tr><td class="menu"><a href="/x">Index</a><br><a href="/y">Archive</a></td><td data-content><p>In spring the birds come back from the south, and with them the first warm evenings.</p><p>They nest under the roof, where the cats cannot reach them.</p></td></tr></table><div class="copyright">Copyright, some years ago</div></body>',
    '<body><h1 data-content>A letter</h1><p data-content>I am writing to you from the coast, where the wind has not stopped since we came here.</p><p data-content>We walk on the beach in the morning; in the afternoon we read.</p><p data-content>Yours.</p><form><p>Write to us and we will answer as soon as we can.</p><input><button>Send</button></form><div class="ad"><p>Buy one, get one for free, only today and only here.</p></div></body>',
    '<body><nav><a href="/">Start</a></nav><article data-content><h1>Bread</h1><p>Flour, water, salt and time are all that a good loaf needs.</p><aside data-not><p>Related: how to clean an oven without any chemicals at all.</p></aside><h2>The dough</h2><p>Mix it in the evening and let it rest until the next day.</p><section data-not class="comments"><p>Mine did not rise, what did I do wrong? I used warm water as you say.</p></section></article><div class="sidebar"><h3>Newsletter</h3><p>Get our best recipes once a week in your mailbox.</p></div></body>',
    '<body><div><div><div class="links"><a href="/1">one</a> | <a href="/2">two</a> | <a href="/3">three</a></div><div data-content><h3>Notes on a walk</h3><div>From the station we went uphill, past the last houses and into the wood.</div><div>There was nobody there, and it was very quiet.</div><pre>km 12, 400 m up</pre></div></div><div class="share"><p>Share this page with your friends</p></div><div role="contentinfo"><p>Hosted by nobody in particular.</p></div></div></body>',
    '<body><div><a href="/i">Index</a> <a href="/s">Search</a></div><div data-content><h2>On the lake</h2><div>We took the boat out early, when there was still mist on the water.</div><div>Nobody spoke.</div><div>By noon it was hot, and we swam to the island and back.</div></div><div class="related"><div><a href="/r">Another lake, another summer</a></div></div><div>Page made by hand</div></body>',
)


class Node:
    __slots__ = ("tag", "parent", "features", "own", "linked", "label", "order")

    def __init__(self, tag: str, parent: int, features: list[str], label: int | None):
        self.tag, self.parent, self.features, self.label = tag, parent, features, label
        self.own, self.linked = [], 0  # (place in the page, text); characters in links


def kind(tag: str) -> str:
    return "root" if tag in ROOT else "side" if tag in SIDE else "text" if tag in TEXTUAL else "box"


def parse(page: str) -> list[Node]:
    """The block elements of a page, parents before children; inline elements belong to the block around them. Never fails: unclosed and stray tags are put up with."""
    nodes = [Node("html", -1, ["tag:html"], None)]
    stack, place, at, link, held, foreign = [0], 0, 0, 0, [], 0

    def flush() -> None:
        nonlocal held, place
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                nodes[stack[-1]].own.append((place, text))
                place += 1
            held = []

    def words(raw: str) -> None:
        held.append(raw)
        if link:
            nodes[stack[-1]].linked += len(raw.strip())

    size = len(page)
    while at < size:
        m = MARKUP.search(page, at)
        if not m:
            words(page[at:])
            break
        if m.start() > at:
            words(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in EMBEDDED:
                held.append(" ")
                foreign = max(0, foreign - (tag in FOREIGN))
            elif tag == "a":
                link = max(0, link - 1)
            elif tag in BLOCKS:
                open_at = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag), 0)
                flush()
                if open_at:
                    del stack[open_at:]
                    link = 0
            continue
        if tag in EMBEDDED:
            held.append(" ")
            foreign += tag in FOREIGN and not m[3].endswith("/")
        elif tag in SKIPPED:
            if foreign and m[3].endswith("/"):
                continue  # in svg and math any element may be empty
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            held.append(" ")
        elif tag == "a":
            link += 1
        elif tag in BLOCKS:
            flush()
            foreign = 0
            if nodes[stack[-1]].tag == "p":
                stack.pop()
            closes = CLOSES.get(tag)
            if closes and nodes[stack[-1]].tag in closes:
                while len(stack) > 1 and nodes[stack[-1]].tag in closes:
                    stack.pop()
            link = 0
            if tag == "html":
                continue
            features, label = [f"tag:{tag}"], nodes[stack[-1]].label
            if m[3]:
                for a, x, y, z in ATTRIBUTE.findall(m[3]):
                    a = a.lower()
                    if a in ("class", "id", "role"):
                        parts = set(NAME_PART.findall((x or y or z).lower()))
                        if parts & OUTSIDE or parts & {"navigation", "contentinfo", "complementary"}:
                            features.append("name:outside")
                        elif parts & INSIDE:
                            features.append("name:inside")
                if "data-content" in m[3]:
                    label = 1
                elif "data-not" in m[3]:
                    label = 0
                if "hidden" in m[3] or "display:none" in m[3].replace(" ", ""):
                    features.append("hidden")
            nodes.append(Node(tag, stack[-1], features, label))
            stack.append(len(nodes) - 1)
        elif tag == "br" or tag == "hr":
            held.append(" ")
    flush()
    for n in nodes:
        n.features = [*dict.fromkeys(n.features), *text_features(n)]
    return nodes


def text_features(node: Node) -> list[str]:
    if not node.own:
        return ["empty"]
    text = " ".join(t for _, t in node.own)
    size = len(text)
    share = node.linked / size
    return [f"size:{0 if size < 20 else 1 if size < 60 else 2 if size < 200 else 3}", f"links:{0 if share < 0.05 else 1 if share < 0.5 else 2}",
            f"stop:{int(text[-1] in '.!?:;”»…')}", f"commas:{int(text.count(',') * 100 >= size)}"]


def label_by_article(nodes: list[Node]) -> bool:
    """Labels nodes in the page's one ``article`` (else ``main``) as content, but for sides within; False if the page has not exactly one."""
    for tag in ("article", "main"):
        found = [i for i, n in enumerate(nodes) if n.tag == tag]
        if len(found) == 1:
            for i, n in enumerate(nodes):
                up = nodes[n.parent].label if n.parent >= 0 else 0
                side = n.tag in SIDE and n.tag != "header" or "name:outside" in n.features
                n.label = int(i == found[0] or bool(up) and not side)
            return True
    return False


def count_page(nodes: list[Node], plain: bool, weight: int, counts: Counter) -> None:
    """Adds a labelled page. With ``plain`` its tags that name content are hidden, so that other features must do."""
    for n in nodes:
        y = int(n.label or 0)
        tag = "div" if plain and n.tag in ("article", "main") else n.tag
        counts["node", "", y] += weight
        for f in n.features:
            counts["feature", f"tag:{tag}" if f.startswith("tag:") else f, y] += weight
        if n.parent >= 0:
            up = nodes[n.parent]
            counts["edge", f"{kind(up.tag)}>{kind(n.tag)}", 2 * int(up.label or 0) + y] += weight


class Model:
    """Log potentials from counts, with additive smoothing."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        total = [counts.get(("node", "", y), 0) + 2 for y in (0, 1)]
        names = {f for k, f, _ in counts if k == "feature"}
        self.odds = {f: PARTS.get(f.split(":")[0], TEXT_PART) * (math.log((counts.get(("feature", f, 1), 0) + 1) / total[1]) - math.log((counts.get(("feature", f, 0), 0) + 1) / total[0])) for f in names}
        self.edges = {}
        for k in {f for k, f, _ in counts if k == "edge"}:
            n = [counts.get(("edge", k, i), 0) + 1 for i in range(4)]
            self.edges[k] = tuple(math.log(n[i] / (n[i - i % 2] + n[i - i % 2 + 1])) for i in range(4))
        self.unknown = (math.log(0.8), math.log(0.2), math.log(0.2), math.log(0.8))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The log odds of each node being content, by messages up and down the tree."""
        n = len(nodes)
        odds = self.odds
        unary = [sum(odds.get(f, 0.0) for f in x.features) for x in nodes]
        edge = [self.unknown] * n
        up0, up1 = [0.0] * n, [0.0] * n  # product of the children's messages, for each state of the node
        sent0, sent1 = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):
            x = nodes[i]
            e = edge[i] = self.edges.get(f"{kind(nodes[x.parent].tag)}>{kind(x.tag)}", self.unknown)
            a, b = up0[i], up1[i] + unary[i]
            sent0[i], sent1[i] = _add(e[0] + a, e[1] + b), _add(e[2] + a, e[3] + b)
            up0[x.parent] += sent0[i]
            up1[x.parent] += sent1[i]
        down0, down1, out = [0.0] * n, [-2.0] * n, [0.0] * n
        for i in range(n):
            if i:
                x = nodes[i]
                p, e = x.parent, edge[i]
                # What the parent knows without this child's own message.
                a = down0[p] + up0[p] - sent0[i]
                b = down1[p] + up1[p] - sent1[i] + unary[p]
                down0[i], down1[i] = _add(e[0] + a, e[2] + b), _add(e[1] + a, e[3] + b)
            out[i] = down1[i] + up1[i] + unary[i] - down0[i] - up0[i]
        return out


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def extract(page: str, model: Model) -> str:
    """The page's main text: its content blocks in page order, joined by one space."""
    nodes = parse(page)
    odds = model.marginals(nodes)
    return " ".join(t for _, t in sorted(part for n, o in zip(nodes, odds, strict=True) if o > 0 for part in n.own))


def train(pages: DataFrame, train_pages: int = 2000, seed_weight: int = 25) -> Model:
    """The model of at most ``train_pages`` labelled pages, those with the smallest hashes, and of SEEDS, each counted ``seed_weight`` times.

    Tasks count features; what reaches the driver is one number per feature, of which there are a few hundred at most.
    """
    found = schema("what string, name string, state int, n long")
    arrow = to_arrow_schema(found)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in parts:
            for i, page in enumerate(part.column("html").to_pylist()):
                nodes = parse(page or "")
                if label_by_article(nodes):
                    count_page(nodes, i % 2 == 0, 1, counts)
        rows = [(*k, n) for k, n in counts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    marked = pages.select("html", F.xxhash64("html").alias("h")).where(F.col("html").rlike("(?i)<(article|main)[ >]"))
    # Hashes alone are sorted; pages are read only up to the last hash that is needed.
    last = marked.select("h").distinct().orderBy("h").limit(train_pages).agg(F.max("h")).first()[0]
    sample = marked.where(F.col("h") <= F.lit(last).cast("long")).dropDuplicates(["h"]).select("html")
    rows = sample.mapInArrow(run, found).groupBy("what", "name", "state").agg(F.sum("n").alias("n")).collect()
    counts = Counter({(r.what, r.name, r.state): r.n for r in rows})
    for seed in SEEDS:
        for plain in (False, True):
            count_page(parse(seed), plain, seed_weight, counts)
    return Model(counts)


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; columns of those names are replaced.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by one. Null and empty pages, and pages without content,
    have an empty text. Rows are judged one by one: repeated rows alike, ties don't arise, and an empty table gives an empty result. Without labelled
    pages in the table the model rests on SEEDS alone.
    """
    kept = pages.drop("text", "n_chars")
    model = model or train(pages)
    out = StructType([*kept.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])
    arrow = to_arrow_schema(out)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(x.as_py() or "", model) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return kept.mapInArrow(run, out)
