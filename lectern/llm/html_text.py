"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks. A small linear classifier gives each block a log-odds of being content; its costs are the
capacities from the source and to the sink. Blocks that follow one another, or lie close in the DOM, are tied by
smoothness edges. The minimum cut of that graph separates content from boilerplate. All takes time linear in the page,
however deep it is nested.

The classifier's weights are set by hand, not learned. None outweighs all others: a block of one word has odds against it
even within an article, and it is the edges to its neighbours there that make it content; a lone sentence between menus
goes with these. Edges fall steeply with the distance in the DOM, so the border of an article is cheap to cut. Marks are read relative to the
page's root, the element that holds the article: what encloses the root says nothing about the blocks in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "option", "legend"}
WIDGETS = frozenset("button select svg".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head fieldset button select svg noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p li blockquote pre td th dd dt figcaption h1 h2 h3 h4 h5 h6".split())
SELF_CLOSING = frozenset("li td th tr dd dt option".split())
# Words in class or id that tell boilerplate and content, and words that make a name one of a state
SHADY = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login share sharing social related recommended widget toolbar comment comments reply replies discussion disqus respond skip pagination pager copyright legal disclaimer masthead topbar".split())
GOOD = frozenset("article content main post entry story body text".split())
STATE = frozenset("with without has no not is enabled disabled enable disable open closed on off active inactive ready visible allowed layout page".split())
# Weights of the classifier; OUTER is the share that a mark above an article or main element has
W_BIAS, W_WORDS, W_LINKS, W_PROSE, W_MAIN, W_TITLE, W_TAG, W_SHADY, W_GOOD, W_HEADER, W_SIGN, W_OUT = -2.7, 1.0, -2.5, 0.8, 1.8, 0.9, -3.0, -2.5, 0.4, -2.0, -1.0, -1.0
OUTER = 0.3
SMOOTH, DECAY, REACH = 0.8, 2.0, 3

# A quoted value that runs from a tag's end into the next tag has lost its quote: the quote is then a character
_VALUE = r"""\s*+(?:"(?![^"<>]*+>[^"<]*+<[a-zA-Z/!])[^"]*+"|'(?![^'<>]*+>[^'<]*+<[a-zA-Z/!])[^']*+')"""
TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>"'=<]*+)((?:[^>"'=]++|=(?:{_VALUE})?+|["'])*+)>""")
MARKS = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
GAPS = re.compile(r"\s+")


class Element:
    """An open or closed element; what its ancestors say is gathered once the page's root is known."""

    __slots__ = ("up", "depth", "name", "shady", "good", "hidden", "chars", "says")

    def __init__(self, up: Element | None, name: str, attrs: str):
        self.up, self.depth, self.name, self.chars, self.says = up, up.depth + 1 if up else 0, name, 0, None
        self.shady = self.good = self.hidden = False
        if attrs:
            for m in MARKS.finditer(attrs):
                for one in (m[2] or m[3] or m[4] or "").lower().split():
                    words = set(re.split(r"[^a-z0-9]+", one))
                    self.shady |= one in SHADY or bool(words & SHADY and not words & STATE)
                    self.good |= bool(words & GOOD)
            self.hidden = HIDDEN.search(attrs) is not None


class Block:
    """A run of text between block elements; low: the least depth of the elements open since the block before."""

    __slots__ = ("parts", "at", "low", "linked", "text", "odds")

    def __init__(self, at: Element, low: int):
        self.parts, self.at, self.low, self.linked = [], at, low, 0


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks and the elements, both in page order."""
    lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]", lambda m: m[0].lower(), page)
    last_end, last = page.rfind(">"), {}
    stack = [Element(None, "", "")]
    elements, out, here, low, pos, n = [stack[0]], [], None, 0, 0, len(page)
    names: Counter = Counter()

    def close(name: str) -> None:
        nonlocal low, here
        while True:
            gone = stack.pop().name
            names[gone] -= 1
            here = None if gone in BLOCKS else here
            low = min(low, len(stack) - 1)
            if gone == name:
                return

    def ends_later(name: str, at: int) -> bool:
        if name not in last:
            last[name] = lower.rfind(f"</{name}")
        return last[name] > at

    while pos < n:
        start = page.find("<", pos)
        if start != pos:
            piece = page[pos : start if start >= 0 else n]
            pos += len(piece)
        elif page.startswith("<!--", pos):
            end = page.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        elif page.startswith("<![CDATA[", pos):
            end = page.find("]]>", pos)
            pos = n if end < 0 else end + 3
            continue
        elif page[pos + 1 : pos + 2] in ("!", "?") or page[pos + 1 : pos + 2] == "/" and not page[pos + 2 : pos + 3].isalpha():
            end = page.find(">", pos)
            pos = n if end < 0 else end + 1
            continue
        elif not page[pos + 1 : pos + 3].lstrip("/")[:1].isalpha():
            piece, pos = "<", pos + 1
        elif pos > last_end:
            break  # a tag that the page leaves open
        elif m := TAG.match(page, pos):
            pos = m.end()
            name, attrs = m[2].lower(), m[3]
            if name in BLOCKS:
                here = None
            if m[1]:
                if names[name]:
                    close(name)
                continue
            if name in VOID:
                continue
            if name in RAW:
                if ends_later(name, pos) or name in ("script", "style"):
                    end = lower.find(f"</{name}", pos)
                    end = page.find(">", end) if end >= 0 else -1
                    pos = n if end < 0 else end + 1
                continue
            if name in CLOSES_P and names["p"]:
                close("p")
            if name in BLOCKS and name != "option":
                for w in WIDGETS:
                    if names[w]:  # blocks are no part of these: its end is missing
                        close(w)
            if name in SELF_CLOSING and stack[-1].name == name:
                close(name)
            if attrs.rstrip().endswith("/") or name in ("noscript", "template") and not ends_later(name, pos):
                continue
            elements.append(Element(stack[-1], name, attrs))
            stack.append(elements[-1])
            names[name] += 1
            continue
        else:
            piece, pos = "<", pos + 1
        if here is None:
            if not piece.strip():
                continue
            here = Block(stack[-1], low)
            out.append(here)
            low = len(stack) - 1
        text = html.unescape(piece) if "&" in piece else piece
        here.parts.append(text)
        size = len(text.strip())
        here.linked += size if names["a"] else 0
        stack[-1].chars += size
    for b in out:
        b.text = GAPS.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text], elements


def _root(found: list[Block], elements: list[Element]) -> Element | None:
    """The element that holds the article: the article or main element with the most text, else what holds most prose."""
    total = 0
    own = Counter()
    for b in found:
        e = b.at
        for _ in range(3):
            if e.name in PROSE and e.up:
                own[id(e.up)] += len(b.text) - b.linked
                break
            e = e.up or e
    for e in reversed(elements):  # children come after their parents
        if e.up:
            e.up.chars += e.chars
    total = elements[0].chars
    bad = {id(None): False}
    best, most = None, 0
    prose, much = None, 0
    for e in elements:
        bad[id(e)] = bad[id(e.up)] or e.shady or e.name in BOILERPLATE - {"form", "fieldset"}
        if e.name in ("article", "main") and e.chars > most and (not bad[id(e)] or 2 * e.chars >= total):
            best, most = e, e.chars
        elif e.name not in ("article", "main") and not bad[id(e)] and own[id(e)] > much:
            prose, much = e, own[id(e)]
    inner = [e for e in elements if e.name == "article" and best is not None and best.name == "main" and 2 * e.chars >= best.chars and not bad[id(e)]]
    return max(inner, key=lambda e: e.chars) if inner else best or prose


def score(found: list[Block], elements: list[Element]) -> None:
    """Sets the blocks' odds: how much likelier content than boilerplate each is, taken alone."""
    root = _root(found, elements)
    around, e = set(), root
    while e is not None:
        around.add(id(e))
        e = e.up
    strong = root is not None and root.name in ("article", "main") and 2 * root.chars >= elements[0].chars
    # says: marks of the element and above: inside the main part, tag, shady (above the main part, in or without it), good, header, heading, prose
    for e in elements:
        main, tag, outer, shady, good, header, heading, near = e.up.says if e.up else (False, False, False, False, False, False, False, 0)
        if id(e) not in around:
            tag, shady, header = tag or e.name in BOILERPLATE or e.hidden, shady or e.shady, header or e.name == "header"
        if e.name in ("article", "main") or e is root:
            if not (e.shady and id(e) not in around):
                main, outer, shady = True, outer or shady, False
        e.says = main, tag, outer, shady, good or e.good and e.name not in ("body", "html"), header, heading or e.name in HEADINGS, 3 if e.name in PROSE else max(0, near - 1)
    for b in found:
        main, tag, outer, shady, good, header, heading, near = b.at.says
        x = W_BIAS + W_WORDS * min(2.0, math.log1p(b.text.count(" ")) / 2) + W_LINKS * min(1.0, b.linked / len(b.text))
        x += W_PROSE * (near > 0) + W_MAIN * main + W_TITLE * (main and heading) + W_TAG * tag + W_SHADY * (shady or outer and OUTER) + W_GOOD * good
        x += W_HEADER * (header and not (main and heading)) + W_OUT * (strong and not main and not heading) + W_SIGN * b.text.startswith("©")
        b.odds = x


def _level(b: Block) -> int:
    """The depth of the block element that a block lies in: marks inside a line are no distance."""
    e = b.at
    while e.up and e.name not in BLOCKS:
        e = e.up
    return e.depth


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between blocks up to REACH apart, falling with their distance in page and DOM."""
    out, level = {}, [_level(b) for b in found]
    for i, a in enumerate(found):
        low = a.at.depth
        for j in range(i + 1, min(i + 1 + REACH, len(found))):
            low = min(low, found[j].low)
            out[i, j] = SMOOTH / (j - i) * math.exp(-max(0, level[i] + level[j] - 2 * min(low, level[i], level[j]) - 2) * DECAY)
    return out


def min_cut(odds: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """Labels of least cost: a node on the wrong side pays the size of its odds, an edge across the cut its weight.

    Nodes whose odds outweigh all their open edges are settled first; that is exact and leaves small graphs. There each
    node of the source pushes its flow along shortest augmenting paths; nodes from which no path is left are on the
    source's side for good and are not visited again.
    """
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in ties.items():
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) > sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    supply, drain = {i: max(0.0, odds[i]) for i in rest}, {i: max(0.0, -odds[i]) for i in rest}
    closed: set[int] = set()
    for i in rest:
        while supply[i] > 1e-9 and i not in closed:
            came, queue, end = {i: i}, deque([i]), None
            while queue and end is None:
                u = queue.popleft()
                if drain[u] > 1e-9:
                    end = u
                    break
                for v, w in near[u].items():
                    if w > 1e-9 and v not in came and v not in closed:
                        came[v] = u
                        queue.append(v)
            if end is None:
                closed.update(came)
                break
            flow, v = min(supply[i], drain[end]), end
            while v != i:
                flow, v = min(flow, near[came[v]][v]), came[v]
            v = end
            while v != i:
                near[came[v]][v] -= flow
                near[v][came[v]] += flow
                v = came[v]
            supply[i] -= flow
            drain[end] -= flow
    return [i in closed if x is None else x for i, x in enumerate(label)]


def main_text(page: str) -> str:
    found, elements = blocks(page)
    score(found, elements)
    keep = min_cut([b.odds for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text (main text; blocks joined by one line feed) and n_chars (its code points); other columns stay.

    Columns of these names are replaced. Null, empty or textless html gives an empty text; repeated rows are read each;
    an empty table gives an empty result. Nothing is shortened. Narrow: each page is labelled on its own.
    """

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.fillna("").map(main_text)

    return pages.withColumn("text", extract(F.col("html").cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
