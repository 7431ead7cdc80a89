"""Main text of web pages by minimum-cut labelling of their blocks (operator 1).

A page is cut into blocks: runs of text between block-level tags, each with the elements it lies in. The nodes of
the cut are the blocks and those elements of which a tag, role, class or id says something. A block's terminal
capacity is a classifier's cost of either label from its text alone (length, punctuation, share of linked text,
heading); an element's is what it says, once for each block below it. What an element says reaches the text only
over edges: DOM proximity joins each block, and each such element, to the next one around it, adjacency joins
blocks that follow one another, and blocks that share a parent, weaker with the DOM distance. The minimum cut
(max-flow) parts content from boilerplate: prose in a comment section goes, a bare link in an article stays.

Defined results: null, empty and markup-only pages have the text ''; text outside any element counts;
comments, scripts, styles, templates, controls and hidden elements have no text; unclosed and misnested tags
are read leniently (a block-level tag ends an open paragraph, an unknown end tag is ignored, a tag, comment or
quoted value that never ends reaches to the end of the page); character references are decoded once; rows that
repeat are extracted alike; an empty table gives an empty table; a column named as the output is replaced, all
others are kept whatever their names; a page of any length is read whole, in time about linear in it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadline.llm.common import by_place, byte_sizes, slices, tidied

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<raw>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?。！？…:;,](?:\s|$)")

#: Phrases of short blocks above and below a page's text.
IMPRINT = re.compile(r"©|\(c\) ?(?:19|20)\d\d|\bcopyright\b|all rights reserved|privacy policy|terms of (?:use|service)|powered by|skip to content|(?:we|this site) uses? cookies|sign up for|subscribe to|log ?in\b|follow us", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Read to their own end tag, whatever stands between.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SILENT = RAW | frozenset("head svg annotation annotation-xml object select button audio video canvas map datalist meter progress".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option caption".split()
)
#: Start tags that end an open element of these names, within the nearest of the scopes.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
ENDED = {"p"}.union(*ENDS.values())
SCOPE = frozenset("ul ol dl table div section article body html select menu nav".split())

#: What tags and roles that are never content say: more than any text of a block can say for it.
AGAINST = -12.0
#: What a word of a class or id says against: a block of prose says up to 5 for itself and its neighbours and what is around it say the rest, so
#: that no word decides alone. Words that content is named by as well say less, least of all as a part of a longer name.
WORD_AGAINST, DOUBTFUL, DOUBTFUL_PART = -8.0, -5.0, -2.5
#: What an enclosing element says for (+) or against (-) content: by tag, role, and word of its class or id.
TAG_WEIGHT = {"article": 5.0, "main": 4.0, "fieldset": -4.0} | dict.fromkeys("nav footer aside form menu dialog search".split(), AGAINST)
ROLE_WEIGHT = {"main": 4.0, "article": 5.0} | dict.fromkeys("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar menuitem toolbar tablist status note doc-footnote".split(), AGAINST)
GOOD = frozenset("article content entry main story post body text prose".split())
BAD = frozenset(
    (
        "ad ads adv advert advertisement advertising adverts adsense adslot banner sponsor sponsored sponsors promo promos teaser nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar "
        "comment comments commentlist disqus share sharing social socials related recommended recommendations trending cookie cookies consent gdpr popup modal newsletter subscribe subscription signup paywall pagination pager widget widgets offscreen "
        "notice notices notification notifications alert alerts announcement disclaimer warning discussion respond replies reviews"
    ).split()
)
#: Words that name boilerplate as often as a part of the text.
MAYBE_BAD = frozenset("promotion promoted crumbs rail foot reply follow popular overlay signin login register paging search tags taglist copyright legal skip".split())
#: "has-sidebar" and its like speak of the page, not of the element.
NEGATED = frozenset("has with no without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Element:
    """An open or closed element. `said` is what it says itself; `named` is the next one around (or itself) that says something."""

    __slots__ = ("tag", "parent", "depth", "said", "named", "worst", "best", "silent", "link", "heading", "article", "home", "block", "ended", "scope")

    def __init__(self, tag: str, parent: Element | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = bool(parent and parent.silent) or tag in SILENT
        self.link = tag == "a" or bool(parent and parent.link)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.said = TAG_WEIGHT.get(tag, 0.0)
        if tag == "header":
            self.said = -2.0 if parent and parent.article else AGAINST
        if attrs and tag not in ("html", "body"):
            self.said += self._said(attrs)
        self.named = self if self.said or not parent else parent.named
        # the strongest words for and against around the text
        self.worst = min(self.said, parent.worst if parent else 0.0)
        self.best = max(self.said, parent.best if parent else 0.0)
        inline = parent is not None and tag not in BLOCK
        # inline elements speak only where they say something against
        self.home = parent.home if inline and self.said >= min(0.0, parent.worst) else self
        self.block = self if not inline else parent.block
        # the outermost open elements of one scope that a start tag can end
        self.scope = self.depth if not parent or tag in SCOPE else parent.scope
        self.ended = {} if self.scope == self.depth else parent.ended
        if tag in ENDED and tag not in self.ended:
            self.ended = self.ended | {tag: self}

    @property
    def against(self) -> bool:
        return self.worst <= -4.5

    def _said(self, attrs: str) -> float:
        own = 0.0
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                own += ROLE_WEIGHT.get(value.strip().lower(), 0.0)
            elif name in ("class", "id"):
                named = [[w.lower() for w in NAME.findall(c)] for c in value.split()]
                said = {w for ws in named if ws and ws[0] not in NEGATED for w in ws}
                if said & BAD:
                    own += WORD_AGAINST
                elif said & MAYBE_BAD:
                    inside = self.parent is not None and self.parent.best > 0
                    own += DOUBTFUL_PART if inside or any(len(ws) > 1 for ws in named) else DOUBTFUL
                elif "header" in said and not said & GOOD:
                    own += -2.0 if self.parent and self.parent.article else AGAINST
                elif said & GOOD:
                    own += 1.5
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                self.silent = True
        return own


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


class Tree:
    """The open elements of a page: a step down or up costs the same at any depth."""

    def __init__(self):
        self.root = self.at = Element("", None)
        self.open: dict[str, list[Element]] = {}

    def enter(self, element: Element) -> None:
        self.open.setdefault(element.tag, []).append(element)
        self.at = element

    def leave(self, element: Element) -> None:
        """Close `element` and all that is open in it."""
        while self.at.depth >= element.depth:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def end(self, tag: str) -> None:
        held = self.open.get(tag)
        # an inline end tag doesn't reach past its block
        if held and (tag in BLOCK or held[-1].depth > self.at.block.depth):
            self.leave(held[-1])

    def start_block(self, tag: str) -> None:
        """A block-level tag ends an open paragraph with all inside it, or an open element of its like."""
        ended = [e for t in ("p", *ENDS.get(tag, ())) if (e := self.at.ended.get(t)) is not None and e.depth > 0]
        if ended:
            self.leave(min(ended, key=lambda e: e.depth))
        if tag == "body" and self.at.tag == "head":
            self.leave(self.at)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, white space collapsed and character references decoded."""
    out: list[Block] = []
    tree = Tree()
    parts, linked = [], 0
    home = tree.root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, home, linked))
            parts, linked = [], 0

    def add(text: str, element: Element) -> None:
        nonlocal home, linked
        if element.silent or not text:
            return
        if not parts:
            if text.isspace():
                return
            home = element.home
        parts.append(text)
        if element.link:
            linked += len(text)

    pos, end = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, pos), None):
        if m.start() > pos:
            add(entities.unescape(page[pos : m.start()]), tree.at)
        pos = m.end()
        if m["raw"] is not None:
            add(m["raw"], tree.at)
            continue
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "p" or tag in BLOCK:
                flush()
            tree.end(tag)
            continue
        if tag in ("br", "hr", "img", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ", tree.at)
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            flush()
            tree.start_block(tag)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*+>", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        if not m["attrs"].rstrip().endswith("/") or tag in BLOCK:
            child = Element(tag, tree.at, m["attrs"])
            if child.against and child.worst < tree.at.worst and tag not in BLOCK:
                flush()
            tree.enter(child)
    if pos < end:
        add(entities.unescape(page[pos:]), tree.at)
    flush()
    return out


def score(b: Block) -> float:
    """Log-odds that a block is content, from its text alone: its length, sentences, links, being a heading, and phrases that stand under pages."""
    words = len(WORD.findall(b.text))
    links = b.linked / max(1, len(b.text))
    imprint = -3.5 if words <= 30 and IMPRINT.search(b.text) else 0.0
    return -0.4 + 0.75 * math.log1p(words) + (0.6 if SENTENCE.search(b.text) else 0.0) - 4.0 * links + (0.5 if b.element.heading else 0.0) + imprint


def distance(a: Element, b: Element) -> int:
    """Steps between two elements over their nearest common ancestor."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


class Flow:
    """Max-flow by level graphs and blocking flows (Dinic); min_side() is the source's side of the minimum cut."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, u: int, v: int, there: float, back: float = 0.0) -> None:
        for a, b, c in ((u, v, there), (v, u, back)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.room.append(c)

    def run(self, s: int, t: int) -> float:
        total, n = 0.0, len(self.out)
        while True:
            level = [-1] * n
            level[s] = 0
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in self.out[u]:
                    if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                        level[self.to[e]] = level[u] + 1
                        queue.append(self.to[e])
            self.level = level
            if level[t] < 0:
                return total
            tried = [0] * n
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    least = min(self.room[e] for e in path)
                    total += least
                    for k, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    k = next(k for k, e in enumerate(path) if self.room[e] <= 1e-9)
                    u = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while tried[u] < len(self.out[u]):
                    e = self.out[u][tried[u]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        break
                    tried[u] += 1
                if tried[u] < len(self.out[u]):
                    path.append(self.out[u][tried[u]])
                    u = self.to[path[-1]]
                elif path:
                    u = self.to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break

    def min_side(self) -> list[bool]:
        return [x >= 0 for x in self.level]


def smoothness(found: list[Block], adjacent: float, proximity: float) -> dict[tuple[int, int], float]:
    """Capacity of the edge between two blocks: those that follow one another, and next ones of one parent.

    Blocks of which only one stands in an element with strong words against it are held together less.
    """
    out: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, bool], int] = {}
    for i, b in enumerate(found):
        against = b.element.against
        if i:
            a = found[i - 1].element
            out[i - 1, i] = adjacent / max(1, distance(a, b.element)) * (1.0 if a.against == against else 0.2)
        parent = id(b.element.parent or b.element), against
        j = last.get(parent)
        if j is not None:
            out[j, i] = out.get((j, i), 0.0) + proximity
        last[parent] = i
    return out


Edges = dict[tuple[int, int], tuple[float, float]]


def network(found: list[Block], adjacent: float = 1.0, proximity: float = 1.5) -> tuple[list[float], Edges]:
    """Costs of the nodes (the blocks, then the elements that say something; content where positive) and the
    capacities (there, back) of their edges: (i, j) is paid there where i alone is content, back where j alone is."""
    costs = [score(b) for b in found]
    edges: Edges = {ij: (c, c) for ij, c in smoothness(found, adjacent, proximity).items()}
    node: dict[int, int] = {}
    held: list[Element] = []
    for b in found:
        e = b.element.named
        while e.said and id(e) not in node:
            node[id(e)] = -1
            held.append(e)
            if not e.parent:
                break
            e = e.parent.named
    held.sort(key=lambda e: e.depth)
    below = dict.fromkeys(map(id, held), 0)
    for k, e in enumerate(held):
        node[id(e)] = len(found) + k

    def join(child: int, e: Element | None, size: int) -> None:
        if e is not None and e.said:
            below[id(e)] += size
            edges[child, node[id(e)]] = (-min(e.worst, 0.0) * size, max(e.best, 0.0) * size)

    for i, b in enumerate(found):
        join(i, b.element.named, 1)
    for e in reversed(held):
        join(node[id(e)], e.parent.named if e.parent else None, below[id(e)])
    return costs + [e.said * below[id(e)] for e in held], edges


def min_cut(costs: list[float], edges: Edges) -> list[bool]:
    """Which nodes lie on the source's side of the minimum cut (the least such side).

    A node whose cost outweighs all its edges has its label whatever the others have; such nodes are settled first and
    their edges become costs of their neighbours. Max-flow decides the rest.
    """
    costs, near = costs[:], [[] for _ in costs]
    for (i, j), (there, back) in edges.items():
        near[i].append((j, there, back))
        near[j].append((i, back, there))
    side: list[bool | None] = [None] * len(costs)
    queue = deque(range(len(costs)))
    while queue:
        i = queue.popleft()
        if side[i] is not None:
            continue
        rest = [x for x in near[i] if side[x[0]] is None]
        if costs[i] > sum(x[1] for x in rest) + 1e-9:
            side[i] = True
        elif -costs[i] > sum(x[2] for x in rest) + 1e-9:
            side[i] = False
        else:
            near[i] = rest
            continue
        for j, there, back in rest:
            costs[j] += there if side[i] else -back
            queue.append(j)
    left = [i for i, x in enumerate(side) if x is None]
    if all(costs[i] > 0 for i in left) or all(costs[i] <= 0 for i in left):  # no flow from one side to the other
        return [bool(costs[i] > 0 if x is None else x) for i, x in enumerate(side)]
    place = {i: k for k, i in enumerate(left)}
    n = len(left)
    flow = Flow(n + 2)
    for k, i in enumerate(left):
        if costs[i] > 0:
            flow.edge(n, k, costs[i])
        elif costs[i] < 0:
            flow.edge(k, n + 1, -costs[i])
    for (i, j), (there, back) in edges.items():
        if side[i] is None and side[j] is None:
            flow.edge(place[i], place[j], there, back)
    flow.run(n, n + 1)
    for k, kept in zip(left, flow.min_side()):
        side[k] = kept
    return [bool(x) for x in side]


def label(found: list[Block], adjacent: float = 1.0, proximity: float = 1.5) -> list[bool]:
    """Which blocks are content: the side of the source in the minimum cut."""
    return min_cut(*network(found, adjacent, proximity))[: len(found)]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    return "\n\n".join(b.text for b, keep in zip(found, label(found)) if keep) if found else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each; a column of that name is replaced, others may have any name. One pass without a shuffle."""
    if html == out:
        raise ValueError("the html column can't be the output")
    return by_place(pages, (out,), lambda rows, names: _extract(rows, names[pages.columns.index(html)], out))


def _extract(pages: DataFrame, html: str, out: str) -> DataFrame:
    at, schema = pages.columns.index(html), T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            for i, j in slices(byte_sizes(b.column(at)), 4 << 20):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([main_text(x) for x in part.column(at).to_pylist()], pa.string())], schema.names)

    return pages.mapInArrow(tidied(run), schema)
