"""Main-text extraction from raw HTML by minimum-cut labelling of text blocks.

A tolerant reader cuts the page into blocks: runs of text between block-level tags, with the element they stand in. A
linear classifier scores each block by its text (words, share of link text, punctuation, tag; squashed to `TEXT_CAP`) and
by the markers of its ancestors (`MARK` at most). The score is the capacity of the block's edge to the content terminal
or, if negative, to the boilerplate terminal. Smoothness edges join blocks that follow each other, and blocks to the one
before of the same parent and of the same grandparent; they are the heavier the fewer steps lie between the elements in
the tree, and light where a marked element begins or ends between them. Text alone weighs less than the edges of a block
among its like, so a short line between paragraphs goes with them and a wordy teaser among links goes with those.
Maximum flow (Dinic) runs on every page; the side of the content terminal is the main text.

Defined cases: a null or empty page, or one without content, gives an empty text. Every row gives one row. Character
references are decoded once, each stretch between tags for itself; Unicode white space, line breaks (`br`) too, becomes
one blank; blocks are joined by one newline in page order. Broken markup never fails: an unknown end tag is passed over,
an open one ends with its parent, and a `<` that starts no tag is text. Reading takes time in proportion to the page,
however its tags are nested or left open.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import map_rows

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+)(?:[^>]*>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML by their role in a page.
RAW = frozenset("script style textarea title xmp".split())
DROPPED = frozenset("head script style textarea title xmp noscript template iframe select option button datalist form fieldset label input meter progress dialog desc metadata".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
ENDS_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
#: An element that ends an open one of the named kinds when it starts.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("table ul ol dl td th body article section div main nav aside header footer".split())
AWAY_TAGS = frozenset(("nav", "footer", "aside", "menu", "header"))
HOME_TAGS = frozenset(("article", "main"))
AWAY_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus footer
    gdpr hidden masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended
    related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split()
)
HOME_NAMES = frozenset("article articlebody body content entry main post story text".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
NOTICE = re.compile(r"©|\(c\)\s*\d{4}|copyright|all rights reserved|cookie|subscribe|sign in|log in|advertisement", re.IGNORECASE)
#: Most that markers and text say, what an article's own tag and its names say, weights of edges by steps in the tree, and the share left of them at a marked border.
MARK, TEXT_CAP, HOME_TAG, HOME_NAME = 3.0, 2.0, 2.5, 1.5
NEAR, FAR, BORDER = (2.0, 2.0, 2.0, 1.2, 0.5, 0.3), 0.1, 0.15


class Element:
    """An open element: its tag, what its markers say of text inside, and its place in the tree."""

    __slots__ = ("tag", "mark", "border", "dropped", "link", "parent", "home", "depth")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent = tag, parent
        self.home = parent.home if parent and tag not in BLOCK else self  # the nearest block-level element
        self.depth = parent.depth + 1 if parent else 0
        self.mark = parent.mark if parent else 0.0
        self.link = tag == "a" or bool(parent and parent.link)
        self.dropped = tag in DROPPED or bool(parent and parent.dropped)
        if tag in HOME_TAGS and self.mark > -MARK:
            self.mark = HOME_TAG
        elif tag in AWAY_TAGS:
            self.mark = -0.5 if tag == "header" and parent and parent.mark >= HOME_TAG else -MARK
        if attributes and not self.dropped and tag not in ("body", "html"):
            self._marked(attributes)
        self.border = self.mark != (parent.mark if parent else 0.0) or tag in HOME_TAGS

    def _marked(self, attributes: str) -> None:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.dropped = True
            elif name == "role":
                self.mark = -MARK if value.lower() in AWAY_ROLES else HOME_TAG if value.lower() in ("main", "article") and self.mark > -MARK else self.mark
            elif name in ("class", "id", "itemprop"):
                names = {n.lower() for n in NAME.findall(value)}
                away, home = names & AWAY_NAMES, names & HOME_NAMES or value.lower() == "articlebody"
                if away and not (home and self.tag in HOME_TAGS):
                    self.mark = -MARK
                elif home and not away and self.mark > -MARK:
                    self.mark = max(self.mark, HOME_NAME)


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    now = Element("#page", None, "")
    open_: dict[str, list[Element]] = {}  # open elements by tag, the deepest last

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), now.home))
            parts.clear()
        linked = 0

    def deepest(tags) -> int:
        return max((open_[t][-1].depth for t in tags if open_.get(t)), default=0)

    def leave(depth: int) -> None:
        """End all open elements down to that depth."""
        nonlocal now
        while now.depth >= depth:
            open_[now.tag].pop()
            now = now.parent

    def leave_block(tags, stop) -> None:
        """End the nearest open element of `tags`, unless one of `stop` stands inside it."""
        depth = deepest(tags)
        if depth and depth >= deepest(stop):
            close()
            leave(depth)

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        end = m.start() if m else size
        if end > at and not now.dropped:
            piece = html.unescape(page[at:end])
            parts.append(piece)
            if now.link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if m[1]:
            if tag in BLOCK:
                leave_block((tag,), ())
            elif (depth := deepest((tag,))) > now.home.depth:
                leave(depth)
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                close()
            continue
        if tag in ENDS_P:
            leave_block(("p",), SCOPE)
        if tag in ENDS:
            leave_block(ENDS[tag], SCOPE - frozenset(ENDS[tag]))
        if tag in BLOCK:
            close()
        if m[3].endswith("/") and tag not in BLOCK and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = found.end() if found else size
            continue
        now = Element(tag, now, m[3])
        open_.setdefault(tag, []).append(now)
    close()
    return out


def text_score(b: Block) -> float:
    """What a block's text says, above 0 for content."""
    n, tag = b.text.count(" ") + 1, b.element.tag
    links = b.linked / len(b.text)
    x = -0.4 + min(3.0, math.log2(1 + n / 8)) - 4.0 * links
    if tag in ("p", "blockquote", "pre"):
        x += 0.7
    elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "figcaption"):
        x += 0.3
    if b.text[-1] in ".!?…\"'»”:":
        x += 0.5
    if n < 40 and NOTICE.search(b.text):
        x -= 2.5
    return TEXT_CAP * math.tanh(x / TEXT_CAP)


def log_odds(b: Block) -> float:
    """The classifier: above 0 for content, at most MARK + TEXT_CAP either way."""
    return b.element.mark + text_score(b)


def nearness(a: Element, b: Element) -> float:
    """Weight of a smoothness edge by the steps between two elements in the tree and the marked borders on the way."""
    steps, share = 0, 1.0
    while a is not b and steps < 2 * len(NEAR):
        if a.depth >= b.depth:
            share = share * BORDER if a.border else share
            a = a.parent
        else:
            share = share * BORDER if b.border else share
            b = b.parent
        steps += 1
    return (NEAR[steps] if a is b and steps < len(NEAR) else FAR) * share


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [], {}
    for i, b in enumerate(found):
        joined = {i - 1} if i else set()
        up = b.element.parent
        for over in (up, up.parent if up else None):
            before = last.get(id(over)) if over is not None else None
            if before is not None:
                joined.add(before)
            last[id(over)] = i
        edges += [(j, i, nearness(found[j].element, b.element)) for j in sorted(joined)]
    return edges


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the odds given up plus the weights of edges with unlike ends, by maximum flow
    (Dinic) between a source, content, and a sink; of several such labellings the one with least content."""
    n = len(odds)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for i, x in enumerate(odds):
        join(s, i, x, 0.0) if x > 0 else join(i, t, -x, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], line = 0, [s]
        for v in line:
            for e in head[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    line.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(head[v]):
                e = head[v][at[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            if at[v] < len(head[v]):
                path.append(head[v][at[v]])
                v = to[path[-1]]
            elif v == s:
                break
            else:
                v = to[path.pop() ^ 1]
                at[v] += 1


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    keep = minimum_cut([log_odds(b) for b in found], smoothness(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, keep: list[str], page: str = "html") -> DataFrame:
    """Columns `keep`, the main text of each page, and its length in code points."""
    found = map_rows(pages, keep, [page], lambda: lambda value: (main_text(value),), [("text", T.StringType())])
    return found.withColumn("n_chars", F.length("text").cast("long"))
