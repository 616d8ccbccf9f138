"""HTML extraction by minimum cut: which of a page's blocks are content, decided together.

A page is cut into blocks at block elements. A logistic classifier over a block's text, links and place in the
document gives each block a cost for either label; blocks that are neighbours in the page or in the document tree
pay for different labels. The labelling of least total cost is a minimum cut: costs are capacities to two
terminals, neighbourhoods are edges between blocks, and max-flow separates content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.shared import learn_in_task

SAMPLE = 400  # pages that the classifier is trained on at most
SMOOTH, NEAR = 0.8, 0.4  # weight of page neighbours and of tree neighbours
MOST_COST = 6.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")  # where a quote doesn't end
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements that hold no elements, up to their end tag or the page's end, and whose text is no text of the page.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes"}
#: Elements whose text isn't shown. They end with their end tag or their parent; the second ones also before a block.
_MUTE = {"template", "canvas", "audio", "video", "svg", "select"}
_BREAKS = {"svg", "select"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NEGATIVE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "search"}
_POSITIVE_TAGS = {"article", "main"}
#: Names of boilerplate: plain ones, those that content uses too, and those that say nothing beside one of these.
_PLAINLY = re.compile(r"ads?|advert\w*|breadcrumbs?|comments?|cookies?|consent|disqus|footer|login|modal|nav|navbar|navigation|newsletter|pagination|pager|popup|promos?|replies|sidebar|signup|social|sponsors?|sponsored|subscribe|toolbar")
_PERHAPS = re.compile(r"banner|disclaimer|foot|form|head|header|menu|notices?|overlay|related|share|sharing|side|widget")
_FILLER = re.compile(r"area|bar|block|bottom|box|buttons?|col|container|global|inner|items?|left|links?|list|message|page|panel|primary|right|row|secondary|section|site|thread|top|wrapper")
_POSITIVE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?:$|[\s_-])", re.I)
#: An element of the key closes an open one of the values, up to an element of the third column.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_KINDS = ("p", "h", "li", "cell", "quote", "other")


@dataclass
class Block:
    text: str
    tag: str
    sign: int  # of the nearest ancestor that says what it holds: 1 content, -1 boilerplate, 0 none
    links: int  # characters inside links
    depth: int  # open elements around it
    common: int  # of these, the ones around the block before too
    parent: int  # number of the element around the innermost one, 0 without
    doubt: bool = False  # in an article, in an element with a name that boilerplate has too


@dataclass
class _Open:
    tag: str
    number: int
    sign: int
    inside: bool  # an article or the page's main part, or in one
    doubt: bool


def named(names: str) -> int:
    """2 if a class, id or role is plainly a name of boilerplate, 1 if it may be one, else 0.

    All parts of the name must be such names or say nothing: ``cookie-banner`` and ``site-footer``, not ``market-share``."""
    best = 0
    for name in names.lower().split():
        parts = [p for p in re.split("[-_]+", name) if p]
        plain, perhaps = (any(map(k.fullmatch, parts)) for k in (_PLAINLY, _PERHAPS))
        if (plain or perhaps) and all(_FILLER.fullmatch(p) or _PLAINLY.fullmatch(p) or _PERHAPS.fullmatch(p) for p in parts):
            best = max(best, 2 if plain else 1)
    return best


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order: references decoded, white space runs one space, ends trimmed, empty ones left out."""
    src = page or ""
    out, parts, linked, anchor, number, at = [], [], 0, 0, 0, 0
    stack: list[_Open] = []
    opened = Counter()  # open elements by tag
    low = 0  # least depth since the last block
    mute: tuple[str, int] | None = None  # an element that isn't shown, and the depth where it began

    def flush():
        nonlocal linked, low
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1] if stack else None
                out.append(Block(text, top.tag if top else "body", top.sign if top else 0, linked, len(stack), low, stack[-2].number if len(stack) > 1 else 0, bool(top) and top.doubt))
                low = len(stack)
            parts.clear()
        linked = 0

    def say(text):
        nonlocal linked
        if text and not mute:
            t = html.unescape(text) if "&" in text else text
            parts.append(t)
            if anchor:
                linked += len(t.strip())

    def pop_to(i):
        nonlocal low, mute
        flush()
        opened.subtract(o.tag for o in stack[i:])
        del stack[i:]
        low = min(low, i)
        if mute and i < mute[1]:
            mute = None

    size = len(src)
    while at < size:
        lt = src.find("<", at)
        if lt < 0:
            say(src[at:])
            break
        if lt > at:
            say(src[at:lt])
        m = _TOKEN.match(src, lt) or _LOOSE.match(src, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                anchor = max(0, anchor - 1)
            elif mute and tag == mute[0]:
                if len(stack) > mute[1]:
                    pop_to(mute[1])
                mute = None
            elif tag in _BLOCK:
                if opened[tag] <= 0:
                    flush()
                    continue
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        anchor = 0
                        pop_to(i)
                        break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(src, at)
            at = end.end() if end else size
            parts.append(" ")
            continue
        if tag in _MUTE:
            if not mute and not m[3].rstrip().endswith("/"):
                mute = (tag, len(stack))
            parts.append(" ")
            continue
        if tag == "a":
            anchor = 1
        if tag == "br" or tag == "img":
            parts.append(" ")
        if tag not in _BLOCK:
            continue
        if mute and mute[0] in _BREAKS:
            mute = None
        flush()
        anchor = 0
        if tag == "hr":
            continue
        if stack and stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if tag in _CLOSES:
            same, until = _CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in until or not any(opened[t] > 0 for t in same):
                    break
                if stack[i].tag in same:
                    pop_to(i)
        sign = stack[-1].sign if stack else 0
        inside = bool(stack) and stack[-1].inside
        names, hidden = "", False
        if m[3] and tag not in ("html", "body"):
            for name, *values in _ATTR.findall(m[3]):
                v = "".join(values)
                name = name.lower()
                if name in ("class", "id", "role"):
                    names += " " + v
                elif name == "hidden" or (name == "aria-hidden" and v == "true") or (name == "style" and re.search(r"display\s*:\s*none", v)):
                    hidden = True
        if tag in _POSITIVE_TAGS:
            sign = 1
        elif tag in _NEGATIVE_TAGS:
            sign = -1 if tag != "header" or not inside else sign
        bad = named(names) if names and tag not in _POSITIVE_TAGS else 0
        doubt = (bool(stack) and stack[-1].doubt) or (inside and bad == 1)
        if hidden or tag == "head" or bad == 2 or (bad and not inside):
            sign = -1
        elif names and sign == 0 and _POSITIVE_NAMES.search(names):
            sign = 1
        number += 1
        stack.append(_Open(tag, number, sign, inside or tag in _POSITIVE_TAGS, doubt))
        opened[tag] += 1
    flush()
    return out


def _kind(tag: str) -> int:
    if tag == "p":
        return 0
    if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
        return 1
    return {"li": 2, "dt": 2, "dd": 2, "td": 3, "th": 3, "blockquote": 4, "pre": 4, "figcaption": 4}.get(tag, 5)


def features(page: list[Block], semantic: bool = True) -> np.ndarray:
    """A row for each block; ``semantic`` False blanks what its ancestors say."""
    n = len(page)
    x = np.zeros((n, 10 + len(_KINDS)))
    for i, b in enumerate(page):
        size = len(b.text)
        x[i, 0] = 1.0
        x[i, 1] = min(math.log1p(size) / 5, 2)
        x[i, 2] = b.links / max(1, size)
        x[i, 3] = min(sum(map(b.text.count, ".,;!?")) / 5, 2)
        x[i, 4] = float(b.text[-1] in ".!?\"'”»)")
        x[i, 5] = float("©" in b.text)
        x[i, 6] = min(b.depth, 12) / 12
        if semantic:
            x[i, 7], x[i, 8] = float(b.sign > 0), float(b.sign < 0)
            x[i, -1] = float(b.doubt)
        x[i, 9 + _kind(b.tag)] = 1.0
    return x


#: Used where a sample says nothing of either side: long unlinked text is content.
PLAIN = np.array([-2.0, 1.5, -4.0, 1.0, 0.5, -3.0, 0.0, 5.0, -7.0, 0.5, 0.2, -0.5, -0.5, 0.3, -0.3, -2.5])


def fit(pages: list[list[Block]], steps: int = 300) -> np.ndarray:
    """Weights of the classifier, by gradient descent on blocks whose ancestors say what they are, half of the time
    without what they say, so that the text alone decides where no ancestor speaks."""
    rows, y = [], []
    for p in pages:
        if not p:
            continue
        keep = [i for i, b in enumerate(p) if b.sign]
        for semantic in (True, False):
            rows.append(features(p, semantic)[keep])
            y.append(np.array([float(p[i].sign > 0) for i in keep]))
    if not rows:
        return PLAIN
    x, t = np.concatenate(rows), np.concatenate(y)
    if not len(t) or t.min() == t.max():
        return PLAIN
    w = PLAIN.copy()
    weight = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    hist = np.full(len(w), 1e-2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - t) * weight) / len(t) + 1e-3 * (w - PLAIN)
        hist += g * g
        w -= 0.2 * g / np.sqrt(hist)
    # what an ancestor says is never less than in the plain weights
    w[7], w[8] = max(w[7], PLAIN[7]), min(w[8], PLAIN[8])
    return w


class Cut:
    """Max-flow by levels and blocking flows on a graph with two terminals."""

    def __init__(self, n: int):
        self.n, self.to, self.cap, self.out = n, [], [], [[] for _ in range(n + 2)]
        self.s, self.t = n, n + 1

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(forth)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def _levels(self) -> list[int] | None:
        level = [-1] * (self.n + 2)
        level[self.s], line = 0, deque([self.s])
        while line:
            a = line.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.cap[e] > 1e-12 and level[b] < 0:
                    level[b] = level[a] + 1
                    line.append(b)
        return level if level[self.t] >= 0 else None

    def flow(self) -> float:
        total = 0.0
        while (level := self._levels()) is not None:
            nxt = [0] * (self.n + 2)
            path: list[int] = []
            a = self.s
            while True:
                if a == self.t:
                    d = min(self.cap[e] for e in path)
                    total += d
                    for i, e in enumerate(path):
                        self.cap[e] -= d
                        self.cap[e ^ 1] += d
                    cut = next(i for i, e in enumerate(path) if self.cap[e] <= 1e-12)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.out[a]
                while nxt[a] < len(edges):
                    e = edges[nxt[a]]
                    if self.cap[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(edges):
                    path.append(edges[nxt[a]])
                    a = self.to[path[-1]]
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        return total

    def side(self) -> list[bool]:
        """Whether each node is on the source's side after ``flow``."""
        seen, line = [False] * (self.n + 2), deque([self.s])
        seen[self.s] = True
        while line:
            a = line.popleft()
            for e in self.out[a]:
                if self.cap[e] > 1e-12 and not seen[self.to[e]]:
                    seen[self.to[e]] = True
                    line.append(self.to[e])
        return seen[: self.n]


def neighbours(page: list[Block]) -> dict[tuple[int, int], float]:
    """Weights between blocks: of each with the next in the page, less the farther apart in the tree; and with the last one in the same parent."""
    out: dict[tuple[int, int], float] = {}
    latest: dict[int, int] = {}
    for i, b in enumerate(page):
        if i:
            apart = page[i - 1].depth + b.depth - 2 * b.common
            out[i - 1, i] = SMOOTH * 2.0 ** (-max(0, apart - 2) / 2)
        if b.parent in latest:
            j = latest[b.parent]
            out[j, i] = out.get((j, i), 0.0) + NEAR
        latest[b.parent] = i
    return out


def label(page: list[Block], weights: np.ndarray) -> list[bool]:
    """True for content. A block on neither side of a tie is boilerplate."""
    if not page:
        return []
    cost = np.clip(features(page) @ weights, -MOST_COST, MOST_COST).tolist()
    if min(cost) > 0 or max(cost) <= 0:
        return [c > 0 for c in cost]
    cut = Cut(len(page))
    for i, c in enumerate(cost):
        cut.edge(cut.s, i, max(c, 0.0))
        cut.edge(i, cut.t, max(-c, 0.0))
    for (a, b), w in neighbours(page).items():
        cut.edge(a, b, w, w)
    cut.flow()
    return cut.side()


def main_text(page: str | None, weights: np.ndarray = PLAIN) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, yes in zip(found, label(found, weights)) if yes)


def train(pages: DataFrame, key: str = "page_id", text: str = "html") -> np.ndarray:
    """The classifier, from at most ``SAMPLE`` pages, those whose keys have the least hashes; of pages that share a key
    the least. It is trained in one task."""
    src = pages.select(pages[key].alias("k"), pages[text].alias("h"))
    ids = src.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    # SAMPLE ids at most, so they can be broadcast
    rows = src.join(F.broadcast(ids), "k").groupBy("k").agg(F.min("h").alias("h"))

    def learn(got):
        got = sorted(got, key=lambda r: (str(r["k"]), r["h"] or ""))
        return fit([blocks(r["h"]) for r in got])

    return learn_in_task(rows, learn)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of ``pages``: the content blocks in page order, joined by an empty line.

    Null, empty and textless pages give an empty text. Broken markup is read as browsers would where that decides
    blocks: unclosed elements end with their parents, stray ends are ignored. Equal pages give equal texts, and
    repeated rows all stay. Other columns aren't read."""
    cast = pages.sparkSession.sparkContext.broadcast(train(pages, key, text))
    src = pages.select(pages[key].alias("k"), pages[url].alias("u"), pages[text].alias("h"))

    def run(batches):
        w = cast.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(x.as_py(), w) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, "url", "text", "n_chars"])

    return src.mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, url string, text string, n_chars bigint")
