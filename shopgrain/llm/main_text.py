"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags.  A linear classifier
gives every block a cost for being called content and one for being called
boilerplate, from its tags, the names of the elements around it, its share of
link text, its length and its punctuation.  A name counts as a whole, and not
on headings or on an element that holds most of the page; a form counts by its
controls.  These costs are the capacities
from a source and to a sink; blocks that follow each other, and blocks of one
parent, are tied by edges that grow with their nearness in the element tree.
The minimum cut is the labelling of least total cost: isolated short blocks
take the label of what surrounds them.

White space inside a block becomes one space, blocks are trimmed and joined in
page order by a line feed, character references are decoded.  Scripts, styles,
comments and declarations of the markup, titles, form controls, inline adverts
and what is not shown are never text.  A null or empty page gives an empty
text; markup that is broken is read as far as it goes, in time that grows with
its length.  Blocks whose two labels cost the same are boilerplate.  Repeated
pages are rows of their own, an empty table gives no rows, and columns of the
table that are named as the two new ones are replaced by them.  Pages are
independent rows, so nothing is shuffled, and a task holds one batch of pages
at a time.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopgrain.llm.columns import named

# Kinds of elements of the markup language.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset(
    "audio button canvas datalist head iframe map math noframes noscript object option progress script select style "
    "svg template textarea title video".split()
)
#: Elements that may stand in a head; anything else ends it, as its end tag may be left out.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that one of these ends if it is still open, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "p": {"p"},
}
CONTAINERS = frozenset("ul ol menu dl table div section article main body td th blockquote aside nav footer header".split())

#: Cost per element around or at the block, in favour of content if positive.
TAG_COSTS = {
    "article": 3.0, "main": 2.0, "p": 1.0, "blockquote": 0.8, "pre": 0.8, "h1": 0.8, "h2": 0.5, "h3": 0.5, "h4": 0.3,
    "figcaption": 0.3, "nav": -9.0, "menu": -9.0, "aside": -9.0, "form": -9.0, "dialog": -9.0, "footer": -6.0,
    "header": -6.0, "address": -1.0,
}
#: Words of class names and ids that mark boilerplate where no other word than these and the neutral ones stands beside
#: them: "comment-list" and "site-header" do, "tag-politics", "with-sidebar" and "social-effects" do not.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted".split())
BESIDE = ADVERTS | frozenset(
    "related recommended recommendations comment comments disqus reply replies respond share sharing social nav navbar "
    "navigation menu tags pagination pager breadcrumb breadcrumbs".split()
)
WORSE = BESIDE | frozenset(
    "banner sidebar sidebars footer header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal "
    "overlay newsletter subscribe subscription signup login widget widgets copyright legal disclaimer skip search tag".split()
)
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons container content form global icons inner item items left line link links list "
    "main menu-item module outer page panel posts primary region right row secondary section site slot thread top unit wrap "
    "wrapper wp js".split()
)
BETTER = frozenset("article articles post entry story main content body text".split())
_WORDS = re.compile(r"[a-z]+")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTROLS = frozenset(("input", "select", "textarea", "button"))
#: Text that a form may have for each of its controls before it counts as more than a form.
FORM_TEXT = 100
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none|(?:^|;)\s*visibility\s*:\s*hidden")
NAMES_WORSE, NAMES_BETTER, ADJACENT, SIBLING = -8.0, 1.5, 1.2, 0.6
_SENTENCE_END = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")
_SPACE = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--!?\s*>")


class Open(NamedTuple):
    """An open element: its tag, the block-level element that it is or lies in, and whether its text is left out."""

    tag: str
    node: int
    dropped: bool


class Node:
    """A block-level element with what it holds, which is known when it ends."""

    __slots__ = ("tag", "parent", "depth", "named", "chars", "controls", "marks")

    def __init__(self, tag: str, parent: int, depth: int, named: float, chars: int, controls: int, marks: int) -> None:
        self.tag, self.parent, self.depth, self.named = tag, parent, depth, named
        self.chars, self.controls, self.marks = -chars, -controls, -marks

    def end(self, chars: int, controls: int, marks: int) -> None:
        self.chars, self.controls, self.marks = self.chars + chars, self.controls + controls, self.marks + marks

    def cost(self, page_chars: int) -> float:
        """Its own cost.  An element that holds most of the page is not boilerplate for its name."""
        tag = TAG_COSTS.get(self.tag, 0.0)
        if self.tag == "form":
            tag *= min(1.0, FORM_TEXT * max(1, self.controls) / max(1, self.chars))
        most = 2 * self.chars > page_chars and self.marks or 10 * self.chars >= 9 * page_chars
        return tag + (0.0 if self.named < 0 and most else self.named)


class Block(NamedTuple):
    text: str
    linked: int
    #: Cost of the elements around it.
    cost: float
    #: Depth of its element, and of the lowest element that holds the block before it too.
    depth: int
    common: int
    parent: int


class Blocks(HTMLParser):
    """Blocks of a page: text, characters inside links, and the elements around it.

    The places of open elements are kept by tag, so that an end tag finds its
    element, or that there is none, without a walk through the open ones.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.drops: list[int] = []
        self.nodes = [Node("", 0, 0, 0.0, 0, 0, 0)]
        self.found: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.linked = self.links = self.common = self.inside = self.chars = self.controls = self.marks = 0

    def top(self) -> int:
        return self.open[-1].node if self.open else 0

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            at, depth = self.top(), self.nodes[self.top()].depth
            self.found.append((text, self.linked, at, min(self.common, depth)))
            self.common = depth
            self.chars += len(text)
        self.text, self.linked = [], 0

    def blocks(self) -> list[Block]:
        """All blocks, once the page has been read."""
        self.cut()
        self.pop(0)
        costs = [0.0]
        for node in self.nodes[1:]:
            costs.append(costs[node.parent] + node.cost(self.chars))
        return [
            Block(text, linked, costs[at], self.nodes[at].depth, common, self.nodes[at].parent)
            for text, linked, at, common in self.found
        ]

    def end_dropped(self, tag: str) -> None:
        """Close what is still open before this tag (text if empty) and may go without an end tag: heads and options."""
        while self.drops:
            i = self.drops[-1]
            at = self.open[i].tag
            if tag == "body" and at != "head":  # nothing inside a head reaches into the body
                heads = self.places.get("head")
                if not heads:
                    return
                i = heads[0]
            elif not (at == "head" and tag not in HEAD_TAGS or at == "option" and tag in BLOCK_TAGS):
                return
            self.pop(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.end_dropped(tag)
        block = tag in BLOCK_TAGS
        if block:
            self.cut()
            ends = CLOSES.get(tag) or ({"p"} if tag != "html" else None)
            if ends:
                self.end_open(ends)
        elif tag == "br":
            self.text.append(" ")
        self.controls += tag in CONTROLS and ("type", "hidden") not in attrs
        if tag in VOID_TAGS:
            return
        self.marks += tag in ("h1", "article", "main")
        node = at = self.top()
        if block:
            node = len(self.nodes)
            named = name_cost(tag, attrs, self.inside > 0)
            self.nodes.append(Node(tag, at, self.nodes[at].depth + 1, named, self.chars, self.controls, self.marks))
        place = len(self.open)
        dropped = tag in DROPPED_TAGS or not block and left_out(attrs)
        self.open.append(Open(tag, node, dropped))
        self.places.setdefault(tag, []).append(place)
        if tag in CONTAINERS:
            self.containers.append(place)
        if dropped:
            self.drops.append(place)
        self.inside += tag in ("article", "main")
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS and tag in DROPPED_TAGS:
            self.handle_endtag(tag)

    # Markup that does not end reaches to the next ">", or takes the rest of the page with it; so no place of the page is
    # tried twice.

    def behind(self, i: int, end: str = ">") -> int:
        at = self.rawdata.find(end, i)
        return len(self.rawdata) if at < 0 else at + len(end)

    def parse_starttag(self, i: int) -> int:
        k = super().parse_starttag(i)
        return k if k >= 0 else self.behind(i)

    def parse_endtag(self, i: int) -> int:
        k = super().parse_endtag(i)
        return k if k >= 0 else self.behind(i)

    def parse_pi(self, i: int) -> int:
        return self.behind(i)

    def parse_html_declaration(self, i: int) -> int:
        k = super().parse_html_declaration(i)
        return k if k >= 0 else self.behind(i)

    def parse_comment(self, i: int, report: int = 1) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        m = _COMMENT_END.search(self.rawdata, i + 4)
        return m.end() if m else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Behind a marked section of any name, known or not, which is no text."""
        data = self.rawdata[i:i + 9].lower() == "<![cdata[" and self.rawdata.find("]]>", i) >= 0
        return self.behind(i, "]]>" if data else ">")

    def end_open(self, tags: set[str]) -> None:
        """Close the nearest of these elements inside the nearest container."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        if at >= 0 and (not self.containers or at >= self.containers[-1]):
            self.pop(at)

    def pop(self, i: int) -> None:
        while len(self.open) > i:
            x = self.open.pop()
            place = len(self.open)
            self.places[x.tag].pop()
            if self.containers and self.containers[-1] == place:
                self.containers.pop()
            if self.drops and self.drops[-1] == place:
                self.drops.pop()
            self.links -= x.tag == "a"
            self.inside -= x.tag in ("article", "main")
            if x.tag in BLOCK_TAGS:
                self.nodes[x.node].end(self.chars, self.controls, self.marks)
        self.common = min(self.common, self.nodes[self.top()].depth)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
        places = self.places.get(tag)
        if not places:
            return
        # An inline or paragraph end does not reach beyond the container it stands in.
        if tag not in CONTAINERS and tag not in ("html", "body", "form", "head"):
            if self.containers and self.containers[-1] > places[-1]:
                return
        self.pop(places[-1])

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self.end_dropped("")
        if not self.drops:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())


def marks_boilerplate(name: str, words: frozenset[str] = WORSE) -> bool:
    """Whether one class name or id says that its element is boilerplate."""
    parts = _WORDS.findall(name)
    if not any(p in words for p in parts):
        return False
    beside = BETTER if parts[-1] in BESIDE else frozenset()
    return all(p in words or p in NEUTRAL or p in beside or len(p) == 1 for p in parts)


def not_shown(attrs: list[tuple[str, str | None]]) -> bool:
    return any(
        name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true"
        or name == "style" and value and _NOT_SHOWN.search(value.lower()) for name, value in attrs
    )


def left_out(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an inline element is an advert or not shown."""
    return not_shown(attrs) or any(
        marks_boilerplate(part, ADVERTS) for name, value in attrs if name in ("class", "id") and value
        for part in value.lower().split()
    )


def name_cost(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> float:
    """Cost that a block-level element's attributes add to its tag's; ``inside`` an article or main part."""
    if tag in ("html", "body"):
        return 0.0
    cost = NAMES_WORSE if not_shown(attrs) else 0.0
    if tag in HEADINGS:
        return cost
    if tag == "header" and inside:
        return -TAG_COSTS["header"]  # the heading of an article, not of the page
    names = [x for name, value in attrs if name in ("class", "id") and value for x in value.lower().split()]
    # Inside an article a header is the article's own.
    if any(marks_boilerplate(x) and not (inside and "header" in x) for x in names):
        cost += NAMES_WORSE
    elif any(p in BETTER for x in names for p in _WORDS.findall(x)):
        cost += NAMES_BETTER
    if any(name == "role" and (value or "").lower() in _ROLES for name, value in attrs):
        cost += NAMES_WORSE
    return cost


def block_cost(block: Block) -> float:
    """Cost of calling the block boilerplate, less that of calling it content."""
    share = min(1.0, block.linked / len(block.text))
    words = block.text.count(" ") + 1
    cost = block.cost + 0.5 * math.log2(words) - 1.5 - 5.0 * share
    return cost + (0.5 if _SENTENCE_END.search(block.text) else -0.3)


def content(blocks: list[Block]) -> list[bool]:
    """Which blocks the minimum cut leaves on the side of content."""
    n = len(blocks)
    source, sink = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def edge(a: int, b: int, forth: float, back: float) -> None:
        graph[a][b] = graph[a].get(b, 0.0) + forth
        graph[b][a] = graph[b].get(a, 0.0) + back

    last_of: dict[int, int] = {}
    for i, block in enumerate(blocks):
        cost = block_cost(block)
        if cost > 0:
            edge(source, i, cost, 0.0)
        else:
            edge(i, sink, -cost, 0.0)
        if i:
            apart = block.depth + blocks[i - 1].depth - 2 * block.common
            weight = ADJACENT * 0.5 ** (apart / 2)
            edge(i - 1, i, weight, weight)
        if block.parent in last_of:
            edge(last_of[block.parent], i, SIBLING, SIBLING)
        last_of[block.parent] = i
    reached = max_flow(graph, source, sink)
    return [reached[i] >= 0 for i in range(n)]


def max_flow(graph: list[dict[int, float]], source: int, sink: int) -> list[int]:
    """Saturate the graph, phase by phase along shortest ways; then each node's distance from the source, -1 if cut off."""
    tiny = 1e-9
    while True:
        level = [-1] * len(graph)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for b, room in graph[a].items():
                if room > tiny and level[b] < 0:
                    level[b] = level[a] + 1
                    todo.append(b)
        if level[sink] < 0:
            return level
        ways = [iter(list(edges)) for edges in graph]
        way = [source]
        while way:
            a = way[-1]
            if a == sink:
                least = min(graph[x][y] for x, y in zip(way, way[1:], strict=False))
                full = 0
                for k in range(len(way) - 2, -1, -1):
                    x, y = way[k], way[k + 1]
                    graph[x][y] -= least
                    graph[y][x] += least
                    if graph[x][y] <= tiny:
                        full = k
                del way[full + 1 :]  # go on from before the first edge that is full
                continue
            for b in ways[a]:
                if graph[a][b] > tiny and level[b] == level[a] + 1:
                    way.append(b)
                    break
            else:
                way.pop()


#: References to characters by numbers that are too long for one, or begin with zeros.
_LONG_REFERENCE = re.compile(r"&#(?:([xX])0*([0-9a-fA-F]{8,})|0*([0-9]{8,}))(;?)")


def _shorter(m: re.Match[str]) -> str:
    digits = (m[2] or m[3]).lstrip("0")
    return f"&#{m[1] or ''}{digits or 0};" if len(digits) < 8 else "\ufffd"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parser = Blocks()
    parser.feed(_LONG_REFERENCE.sub(_shorter, page))
    parser.close()
    blocks = parser.blocks()
    if not blocks:
        return ""
    return "\n".join(b.text for b, good in zip(blocks, content(blocks), strict=True) if good)


def extracted(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the html replaced by its main text, in a column ``text``, and n_chars, its code points."""
    kept = [c for c in pages.columns if c not in (html_column, text, "n_chars")]
    safe = [f"c{i}" for i in range(len(kept))]
    rows = pages.select(*[named(c).alias(s) for c, s in zip(kept, safe, strict=True)], named(html_column).alias("page"))
    schema = T.StructType([*[rows.schema[s] for s in safe], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [main_text(p) for p in batch.column(len(safe)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(safe))], pa.array(texts, pa.string())], [*safe, "text"]
                )

    out = rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
    return out.toDF(*kept, text, "n_chars")
