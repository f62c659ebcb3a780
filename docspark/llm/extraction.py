"""Operator 5: main text of pages by minimum-cut labelling.

A page becomes text blocks below a tree of elements.  A logistic classifier on
each block's text (length, links, punctuation, kind, place), trained here on a
bounded sample of pages whose elements say what they are (article against nav,
footer and so on), gives a block's cost of either label: capacities to the
terminals.  The element's own meaning, where it has one, is further evidence of
about the same weight, so neither decides alone.  Edges between neighbouring blocks, weaker
the further apart they are in the tree, and from blocks to their element and
from elements to theirs, make a cut between unlike neighbours dear.  The
minimum cut (maximum flow, by level graphs) leaves content with the source.
Elements that are marked as hidden have no blocks.

Null and empty pages, and pages without content, give an empty text.  Broken
markup is read as browsers do: open elements end with the page, an unfinished
tag is dropped.  Very long pages are read whole, in time proportional to their
length.  Without meaningful elements in the sample the classifier keeps its
start weights.  Repeated rows get a row each; of equal cuts the one with the
least content holds.  Empty tables give no rows.  Extra columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Element kinds (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg object canvas audio video select button xmp".split())
TEXT_ONLY = frozenset("script style textarea title iframe noembed noframes xmp".split())
NEGATIVE = frozenset("nav footer aside form menu dialog search header fieldset".split())
POSITIVE = frozenset("article main".split())
NEGATIVE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
NEGATIVE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies discussion disqus cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup login register form search share sharing social related recommended widget pagination pager tags toolbar hidden".split()
)
POSITIVE_NAMES = frozenset("article content post entry story main text body".split())
#: A class name with one of these tells what a page has, not what the element is: has-sidebar, share-enabled (fixed values).
TELLING = frozenset("has with without no enabled disabled open closed".split())
#: What an element says of itself: hidden; negative by its kind or role; a form; readers' comments or else negative by a class word; positive by a class word or role; article; main.
HIDDEN, ELEMENT, FORM, TALK, WORD, NOTHING, NAMED, ARTICLE, MAIN = -5, -4, -3, -2, -1, 0, 1, 2, 3
#: Class words of readers' comments, whose text is like an article's (fixed values).
COMMENTS = frozenset("comment comments reply replies discussion disqus".split())
#: Elements that end when one of these begins (fixed values).
IMPLIED = {
    "p": frozenset(BLOCKS - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary"}), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "option": frozenset(["option", "optgroup"]),
}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
SPACES = re.compile(r"\s+")
#: Start weights of the classifier by feature.
FEATURES = ("one", "log_words", "link_share", "ends_sentence", "sentences", "paragraph", "heading", "item", "place", "signs")
START = np.array([-1.2, 0.9, -4.0, 1.2, 0.3, 0.6, 0.2, -0.8, 0.0, -1.0])
#: Bound of a block's classifier cost.
LIMIT = 3.0
#: Costs from the elements' meaning, on the scale of the classifier's and the edges': an element's kind needs the classifier and edges against it, a class word the classifier alone.  What is hidden isn't seen at all.
UNSEEN, STRUCTURE, WORDS = 20.0, 3.5, 2.5
#: Weights of edges.
NEIGHBOUR, PARENT, HUB = 1.0, 0.5, 0.25
#: Pages that the classifier is fitted on, about: those whose hashed ids fall on as many of the table's rows.
SAMPLE_PAGES = 300


class Block:
    __slots__ = ("anchor", "container", "kind", "parts", "text")

    def __init__(self, container: int, kind: str):
        self.container, self.kind, self.parts, self.anchor, self.text = container, kind, [], 0, ""


class Page:
    """Blocks of a page, and for each element that holds text its parent, depth, meaning (-1, 0, 1) and the meaning's cost."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.ends: dict[str, dict[int, int]] = {}
        self.parent, self.depth, self.own, self.header = [-1], [0], [NOTHING], [False]
        self._read(source)
        self._mean()
        self.blocks = [b for b in self.blocks if self.cost[b.container] < UNSEEN]

    def _read(self, source: str) -> None:
        """Elements and blocks in one pass; every element is opened and closed once, and found by its name without a search."""
        stack: list[tuple[str, int]] = [("", 0)]  # element, container
        open_at: dict[str, list[int]] = {}  # places of open elements in the stack, by name
        blocks_at: list[int] = []  # places of open block elements
        block: Block | None = None
        anchors = at = 0
        find = TAG.search
        size = len(source)

        def add(text: str) -> None:
            nonlocal block
            if text and (block is not None or not text.isspace()):
                if block is None:
                    block = Block(stack[-1][1], stack[blocks_at[-1]][0] if blocks_at else "")
                    self.blocks.append(block)
                block.parts.append(text)
                if anchors:
                    block.anchor += len(text)

        def push(name: str, container: int) -> None:
            nonlocal anchors
            open_at.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks_at.append(len(stack))
            anchors += name == "a"
            stack.append((name, container))

        def close(place: int) -> None:
            """Close the element at a place of the stack and all within it."""
            nonlocal anchors
            while len(stack) > place:
                name = stack.pop()[0]
                open_at[name].pop()
                if name in BLOCKS:
                    blocks_at.pop()
                anchors -= name == "a"

        while at < size:
            m = find(source, at)
            if not m:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing = bool(m[1] or m[4])
            if name == "br" or name == "wbr":
                if name == "br" and block is not None:
                    block.parts.append(" ")
                continue
            if closing:
                if name in BLOCKS:
                    block = None
                own = open_at.get(name)
                # an inline element ends within the block that holds it
                if own and (name in BLOCKS or not blocks_at or own[-1] > blocks_at[-1]):
                    close(own[-1])
                continue
            if name in RAW:
                at = self._skip(source, m.start(), at, name)
                continue
            if name in VOID:
                if name in BLOCKS:
                    block = None
                continue
            if name in BLOCKS:
                block = None
                # kinds that end each other don't nest, so at most one of each is looked at
                for k in range(len(blocks_at) - 1, -1, -1):
                    ends = IMPLIED.get(stack[blocks_at[k]][0])
                    if ends and name in ends:
                        close(blocks_at[k])
                        break
                    if not ends:
                        break
                attributes = m[3] or m[6] or ""
                self.parent.append(stack[-1][1])
                self.depth.append(self.depth[stack[-1][1]] + 1)
                self.own.append(self._says(name, attributes))
                self.header.append(name == "header")
                push(name, len(self.parent) - 1)
            elif name == "a" or not (m[3] or m[6] or "").endswith("/"):
                push(name, stack[-1][1])
        for b in self.blocks:
            b.text = SPACES.sub(" ", html.unescape("".join(b.parts))).strip()
        self.blocks = [b for b in self.blocks if b.text]

    def _skip(self, source: str, start: int, at: int, name: str) -> int:
        """Past the end of an element whose content isn't text of the page; past its tag where it is closed at once or never."""
        if name in TEXT_ONLY:
            m = re.compile(rf"</{name}\s*[^>]*>", re.I).search(source, at)
            return m.end() if m else len(source)
        if name not in self.ends:  # the ends of all elements of the name, in one pass
            ends, opened = self.ends.setdefault(name, {}), []
            for m in re.finditer(rf"<(/?){name}(?=[\s/>])([^>]*)>", source, re.I):
                if not m[1]:
                    if not (name == "svg" and m[2].endswith("/")):
                        opened.append(m.start())
                elif opened:
                    ends[opened.pop()] = m.end()
        return max(at, self.ends[name].get(start, at))

    @staticmethod
    def _says(name: str, attributes: str) -> int:
        """What an element says of itself by kind, role and class words."""
        own = MAIN if name == "main" else ARTICLE if name == "article" else FORM if name == "form" else ELEMENT if name in NEGATIVE else NOTHING
        if attributes and "=" in attributes or "hidden" in attributes:
            bad = good = comments = False
            for key, *values in ATTRIBUTE.findall(attributes):
                key, value = key.lower(), "".join(values).lower()
                if key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    return HIDDEN
                if key == "role" and value in NEGATIVE_ROLES and own not in (MAIN, ARTICLE):
                    own = ELEMENT
                if key == "role" and value in ("main", "article"):
                    own = MAIN if value == "main" else max(own, ARTICLE)
                if key in ("class", "id"):
                    names: set[str] = set()
                    for one in value.split():
                        words = set(re.split(r"[^a-z0-9]+", one))
                        names |= words - NEGATIVE_NAMES if words & TELLING else words
                    if names & NEGATIVE_NAMES and not (names & POSITIVE_NAMES and names & {"header", "side", "form", "text", "tags"}):
                        bad = True
                    if names & {"article", "main", "entry", "story", "post", "content"}:
                        good = True
                    comments |= bool(names & COMMENTS)
            if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes):
                return HIDDEN
            if own == ARTICLE and bad and not good:
                return NOTHING  # an article of comments, say: what is around it and its text decide
            if own == NOTHING and name not in ("html", "body"):
                own = TALK if comments and bad else WORD if bad else NAMED if good else NOTHING
        return own

    def _mean(self) -> None:
        """Each element's meaning and its cost, from what it and those around it say.

        An element that holds the page's main part isn't negative by a class
        word or as a form: a main, or an article where the page has no main and
        every article is within something negative.
        """
        own, parent = self.own, self.parent
        n = len(own)
        under = [False] * n
        for c in range(1, n):
            under[c] = under[parent[c]] or own[parent[c]] < 0
        kind = MAIN if MAIN in own else ARTICLE if all(under[c] for c in range(n) if own[c] == ARTICLE) else None
        holds = [False] * n
        for c in range(n - 1, 0, -1):
            if holds[c] or own[c] == kind:
                holds[parent[c]] = True
        self.meaning, self.cost = [0] * n, [0.0] * n
        for c in range(1, n):
            up, cost, o = self.meaning[parent[c]], self.cost[parent[c]], own[c]
            if cost == UNSEEN or o == HIDDEN:
                up, cost = -1, UNSEEN
            elif o == MAIN:
                up, cost = 1, STRUCTURE
            elif o == ARTICLE:
                up, cost = (1, STRUCTURE) if up >= 0 else (0, 0.0)
            elif holds[c] and o in (FORM, TALK, WORD) or self.header[c] and up > 0 and o == ELEMENT:
                pass
            elif o in (ELEMENT, FORM, TALK):
                up, cost = -1, STRUCTURE
            elif o == WORD and up >= 0:
                up, cost = -1, WORDS
            elif o == NAMED and up == 0:
                up, cost = 1, STRUCTURE
            self.meaning[c], self.cost[c] = up, cost


def features(page: Page) -> np.ndarray:
    n = len(page.blocks)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(page.blocks):
        words = b.text.count(" ") + 1
        sentences = b.text.count(". ") + b.text.count("! ") + b.text.count("? ")
        raw = sum(map(len, b.parts)) or 1
        out[i] = (
            1, np.log1p(min(words, 400)), min(1.0, b.anchor / raw), b.text[-1] in ".!?:;\"'”»", min(3, sentences), b.kind == "p", b.kind[:1] == "h" and b.kind[1:].isdigit(), b.kind in ("li", "td", "th", "option", "dt"),
            i / n, bool(re.search(r"[©®|»›]", b.text)),
        )
    return out


def fit(pages: list[str], ridge: float = 20.0, steps: int = 25) -> np.ndarray:
    """Logistic weights from blocks whose elements have a meaning, drawn towards the start weights."""
    xs, ys = [], []
    for source in pages:
        page = Page(source)
        meaning = np.array([page.meaning[b.container] for b in page.blocks])
        on = meaning != 0
        if on.any():
            xs.append(features(page)[on])
            ys.append(meaning[on] > 0)
    if not xs:
        return START
    x, y = np.concatenate(xs), np.concatenate(ys).astype(float)
    w = START.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * (w - START)
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-5:
            break
    return w


class Flow:
    """Maximum flow by level graphs on an undirected network with terminals."""

    def __init__(self, nodes: int):
        self.n = nodes
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, forth: float, back: float) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forth)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * self.n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def cut(self, source: int, sink: int) -> list[bool]:
        """For each node whether it stays with the source."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            following = [0] * self.n
            while True:  # a blocking flow, path by path
                path: list[int] = []
                a = source
                while a != sink:
                    own = self.edges[a]
                    while following[a] < len(own):
                        e = own[following[a]]
                        if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                            break
                        following[a] += 1
                    if following[a] < len(own):
                        path.append(own[following[a]])
                        a = self.to[own[following[a]]]
                    elif a == source:
                        break
                    else:
                        level[a] = -1
                        a = self.to[path.pop() ^ 1]
                if a != sink:
                    break
                amount = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= amount
                    self.room[e ^ 1] += amount


def distance(page: Page, a: int, b: int) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a != b:
        if page.depth[a] < page.depth[b]:
            a, b = b, a
        a = page.parent[a]
        steps += 1
    return steps


def content(page: Page, weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    n = len(page.blocks)
    if not n:
        return []
    score = np.clip(features(page) @ weights, -LIMIT, LIMIT)
    hubs: dict[int, int] = {}
    for b in page.blocks:
        c = b.container
        while c >= 0 and c not in hubs:
            hubs[c] = n + len(hubs)
            c = page.parent[c]
    source, sink = n + len(hubs), n + len(hubs) + 1
    flow = Flow(sink + 1)
    for i, b in enumerate(page.blocks):
        s = float(score[i]) + page.cost[b.container] * page.meaning[b.container]
        flow.join(source, i, max(s, 0.0), 0.0)
        flow.join(i, sink, max(-s, 0.0), 0.0)
        flow.join(i, hubs[b.container], PARENT, PARENT)
        if i:
            w = NEIGHBOUR / (1 + distance(page, page.blocks[i - 1].container, b.container))
            flow.join(i - 1, i, w, w)
    for c, k in hubs.items():
        if page.parent[c] >= 0:
            flow.join(k, hubs[page.parent[c]], HUB, HUB)
    return flow.cut(source, sink)[:n]


def main_text(source: str | None, weights: np.ndarray = START) -> str:
    page = Page(source or "")
    return "\n".join(b.text for b, own in zip(page.blocks, content(page, weights), strict=True) if own)


def extract(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of pages (page_id, url, html)."""
    number = pages.select("page_id").count()
    chosen = pages if number <= sample else pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(number)) < sample)
    some = chosen.filter(F.col("html").isNotNull()).select("html").limit(2 * sample)  # about ``sample`` rows, but ids may repeat
    weights = fit([r["html"] for r in some.collect()])

    def run(batches):
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))
