"""Operator 8: main-text extraction by minimum-cut labelling.

A page is parsed into blocks (maximal runs of text without a block-level tag
between them).  Each block has two costs: of calling it content and of calling
it boilerplate, from a linear classifier over its ancestors' tags and class
names, its link density, its length and its punctuation.  Blocks are the nodes
of a graph: the costs are capacities to the two terminals, and smoothness
edges join blocks next to each other and blocks of one parent, weighted by how
near they are in the DOM.  A minimum cut (max-flow by shortest augmenting
paths) labels all blocks at once; the content side's text is the result.

Scripts, styles, comments, buttons, form labels and the page's head are never
text.  A head without its end tag ends where HTML says: at the first tag or text
that cannot stand in it.  Some structure is certain (inside ``nav``, ``footer``,
an advert's class name and the like) and gets a capacity no cut pays for, unless
it stands inside the article.  So does a form, unless it is wrapped around
content: around an article or main element, 50 words of prose, or half the prose
of the article (else page) that it stands in.

Rows: null or empty html gives an empty text; broken or unclosed markup is read
as far as it goes; pages are worked through one by one within Arrow batches, so
memory is bounded by the longest page; repeated rows each give a row.
"""

from __future__ import annotations

import math
import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from transitlake.llm.common import map_texts
from transitlake.sources.tables import read_table

# fixed values: element names of HTML
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead title tr ul br""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("""script style noscript template head title svg math canvas object iframe button select
textarea option audio video map""".split())
RAW_TAGS = frozenset("script style".split())
HEAD_TAGS = frozenset("head title base basefont bgsound link meta script style noscript noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer header aside menu dialog".split())
COMMENT_WORDS = frozenset("comment comments reply replies response responses ad promo related".split())
BOILER_WORDS = frozenset("""ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu
breadcrumb breadcrumbs footer foot header masthead sidebar aside widget related recommended share sharing social
comment comments reply replies disqus cookie cookies consent gdpr notice notices popup modal newsletter subscribe
signup login search pagination pager copyright legal disclaimer toolbar skip tags""".split())
# fixed values: an open element that one of these closes
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SPACES = re.compile(r"\s+")
HARD = 1000.0
PROSE_WORDS, WRAPPED_WORDS = 10, 50  # of a block, of a form around content


class _Element:
    __slots__ = ("tag", "parent", "depth", "content", "boiler", "dropped", "form", "wraps")

    def __init__(self, tag: str, attrs: list, parent: "_Element | None"):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        words, hidden = set(), False
        for name, value in attrs:
            if name in ("class", "id", "role"):
                words.update(re.split(r"[^a-z]+", (value or "").lower()))
            hidden |= name == "hidden" or name == "aria-hidden" and value == "true" \
                or name == "style" and "display:none" in (value or "").replace(" ", "").lower()
        up = parent
        article = tag in CONTENT_TAGS
        # inside an article, plain headers are its own; marked boilerplate is not
        marked = bool(words & (COMMENT_WORDS if article else BOILER_WORDS)) and tag not in ("html", "body")
        named = tag in BOILER_TAGS and not (up is not None and up.content > 0 and tag == "header")
        self.content = (up.content if up else 0) + article
        self.boiler = (up.boiler if up else 0) + (marked or named)
        if article and not marked and not (up and up.boiler):
            self.boiler = 0
        self.form = self if tag == "form" else up.form if up else None
        self.dropped = (up.dropped if up else False) or tag in DROPPED_TAGS or hidden \
            or tag == "label" and self.form is not None
        self.wraps = False  # of a form: stands around content
        form = self.form if article and not self.dropped else None
        while form is not None and not form.wraps:
            form.wraps, form = True, form.parent.form


class _Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: _Element):
        self.element, self.text, self.linked = element, [], 0


class _Reader(HTMLParser):
    """Blocks of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Element("#root", [], None)
        self.blocks: list[_Block] = []
        self.block: _Block | None = None
        self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.block = None
        if tag == "body":
            self._close({"head"}, {"body"})
        elif self.at.tag == "head" and tag not in HEAD_TAGS:
            self._leave(self.at)
        if tag in CLOSES:
            self._close(CLOSES[tag], {"ul", "ol", "dl", "table", "select", "tr"} - CLOSES[tag])
        if tag in BLOCK_TAGS and tag != "br":
            self._close({"p"}, set(), nearest=True)
        if tag in VOID_TAGS:
            return
        self.links += tag == "a"
        self.at = _Element(tag, attrs, self.at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def _close(self, tags: set, stops: set, nearest: bool = False):
        """Close the innermost open element of ``tags``; inline elements left
        open in it go with it, but no other block is left."""
        at = self.at
        while at.parent is not None and at.tag not in tags:
            if at.tag in stops or nearest and at.tag in BLOCK_TAGS:
                return
            at = at.parent
        if at.parent is not None:
            self._leave(at)

    def _leave(self, element: _Element):
        at = self.at
        while at is not element.parent:
            self.links -= at.tag == "a"
            at = at.parent
        self.at = element.parent

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.block = None
        at = self.at
        while at.parent is not None and at.tag != tag:
            at = at.parent
        if at.parent is not None:
            self._leave(at)

    def handle_data(self, data):
        if self.at.tag == "head" and data.strip():
            self._leave(self.at)
        if self.at.dropped:
            return
        if self.block is None:
            if not data.strip():
                return
            self.block = _Block(self.at)
            self.blocks.append(self.block)
        self.block.text.append(data)
        if self.links > 0:
            self.block.linked += len(data)


def _find_wrapping_forms(blocks: list[tuple[_Block, str]]):
    """Mark the forms with much of the prose around or in them."""
    if all(b.element.form is None for b, _ in blocks):
        return
    prose: dict[_Element, int] = {}
    for b, text in blocks:
        words = text.count(" ") + 1
        if b.element.boiler or words < PROSE_WORDS or 2 * b.linked > len(text):
            continue
        at = b.element
        while at is not None:
            if at.tag == "form" or at.tag in CONTENT_TAGS or at.parent is None:
                prose[at] = prose.get(at, 0) + words
            at = at.parent
    for form, words in prose.items():
        if form.tag == "form":
            scope = form.parent
            while scope.parent is not None and scope.tag not in CONTENT_TAGS:
                scope = scope.parent
            form.wraps |= words >= WRAPPED_WORDS or 2 * words >= prose[scope]


def _costs(block: _Block, text: str) -> tuple[float, float]:
    """Cost of calling the block boilerplate, cost of calling it content."""
    e = block.element
    if e.boiler or e.form is not None and not e.form.wraps:
        return 0.0, HARD
    if e.content:
        return HARD if block.linked < len(text) or len(text) > 40 else 4.0, 0.5
    words = text.count(" ") + 1
    link = min(1.0, block.linked / max(1, len(text)))
    ends = text[-1:] in ".!?:;\"'»”…。"
    at, heading = e, False
    while at.parent is not None:
        heading |= at.tag in HEADINGS
        at = at.parent
    score = 0.9 * math.log1p(words) - 2.0 + 0.8 * ends - 5.0 * link + 0.8 * heading
    score += 0.6 if e.tag in ("p", "blockquote", "pre") else -0.6 if e.tag in ("li", "td", "div", "body", "#root") else 0.0
    return max(0.0, score) + 0.01, max(0.0, -score)


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(keep: list[float], drop: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Content side of a minimum cut: a node on it pays ``drop``, one off it
    pays ``keep``, an edge across pays its weight."""
    n = len(keep)
    s, t = n, n + 1
    flow: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):
        both = min(keep[i], drop[i])  # paid whichever side it is on
        flow[s][i], flow[i][s] = keep[i] - both, 0.0
        flow[i][t], flow[t][i] = drop[i] - both, 0.0
    for a, b, w in edges:
        flow[a][b] = flow[a].get(b, 0.0) + w
        flow[b][a] = flow[b].get(a, 0.0) + w
    while True:
        parent, queue = {s: s}, deque([s])
        while queue and t not in parent:
            u = queue.popleft()
            for v, c in flow[u].items():
                if c > 1e-9 and v not in parent:
                    parent[v] = u
                    queue.append(v)
        if t not in parent:
            return [i in parent for i in range(n)]
        path, v = [], t
        while v != s:
            path.append((parent[v], v))
            v = parent[v]
        most = min(flow[u][v] for u, v in path)
        for u, v in path:
            flow[u][v] -= most
            flow[v][u] += most


def main_text(html: str, smoothness: float = 1.0) -> str:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    blocks = [(b, text) for b in reader.blocks if (text := SPACES.sub(" ", "".join(b.text)).strip())]
    if not blocks:
        return ""
    _find_wrapping_forms(blocks)
    costs = [_costs(b, text) for b, text in blocks]
    edges, last_of = [], {}
    for i, (b, _) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, smoothness / (1 + _distance(blocks[i - 1][0].element, b.element))))
        group = id(b.element.parent)
        if group in last_of and last_of[group] != i - 1:
            edges.append((last_of[group], i, smoothness / 2))
        last_of[group] = i
    side = min_cut([c[0] for c in costs], [c[1] for c in costs], edges)
    return "\n".join(text for (_, text), content in zip(blocks, side) if content)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """id, ``carry``, __text, __chars."""

    def run(pages):
        texts = [main_text(p) if p else "" for p in pages]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_texts(df, id_col, html_col, "__text string, __chars long", run, carry)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, carry=["url"]).withColumnsRenamed({"__text": "text", "__chars": "n_chars"})


QUERIES = {"op8_html_extract": op8_html_extract}
ORACLE: dict[str, str] = {}
