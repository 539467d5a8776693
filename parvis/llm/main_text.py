"""Main text of a page by a minimum cut between content and boilerplate.

The page is read once into blocks: runs of text between block-level tags, each with
its place in the element tree. A linear classifier turns what is seen of a block
(words, share of linked text, elements and names around it) into two costs, that of
calling it boilerplate and that of calling it content; they become the capacities to
source and sink. Blocks that follow each other, and blocks that follow each other
within one parent, are tied by capacities that shrink with their distance in the
tree, so a short block goes with its neighbours; a heading goes with what follows. The minimum cut is the labelling of
least total cost; it is found by blocking flows.

What a form or a bad name says against the blocks inside does not count where the
element holds most of the page's text and little content would be left outside it:
that is a wrapper, not boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S
)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+")
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: elements around a block, and what they say for content (+) or boilerplate (-)
ELEMENTS = {"article": 3.0, "main": 2.0, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "button": -9.0, "dialog": -9.0, "fieldset": -6.0, "header": -6.0}
GOOD_NAMES = {"article", "content", "entry", "main", "post", "story", "text"}
BAD_NAMES = {
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "copyright", "disclaimer", "discussion", "disqus", "dialog", "foot", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "respond",
    "responses", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
}
GOOD_NAME, BAD_NAME = 1.5, -8.0
LINKED, LINKED_INSIDE = 4.5, 2.0  # what a block that is all links loses, and what it loses in an article
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: a heading that says that what follows is by readers
COMMENTS = re.compile(r"\W*(?:\d+ )?(?:(?:reader |recent )?comments?|leave a (?:comment|reply)|responses|(?:leser)?kommentare?|commentaires?|comentarios?|commenti|coment[aá]rios?)(?: ?\(?\d+\)?)?\W*", re.I)
WRAPPERS = {"form", "fieldset"}  # may hold a whole page
MOST, LEFT = 0.5, 0.25  # a wrapper's least share of the page's text; most content outside it, as a share of the text inside
NEXT, SIBLING, BREAK = 1.0, 0.7, 0.5  # strength of ties between blocks, and what a heading leaves of its ties to what it follows


class Block:
    """Text of a block with what the classifier sees. ``place`` is the element it lies in,
    as (number, place of the parent, depth, tag); ``against`` the innermost element that may be
    a wrapper, as (number, what it says, the next one around it)."""

    __slots__ = ("text", "linked", "around", "place", "inside", "against")

    def __init__(self, text: str, linked: int, around: float, place: tuple, inside: bool = False, against: tuple | None = None) -> None:
        self.text, self.linked, self.around, self.place, self.inside, self.against = text, linked, around, place, inside, against

    @property
    def heading(self) -> bool:
        return self.place[3] in HEADINGS

    def score(self) -> float:
        """Above 0 for content: more words, less linked text, better company. Text that is
        short, not linked and in no bad company is content; links count less in an article."""
        words = self.text.count(" ") + 1
        linked = (LINKED_INSIDE if self.inside else LINKED) * self.linked / len(self.text)
        return min(words, 30) / 10 - linked + 0.5 * self.heading + self.around


def _element(tag: str, attributes: str, inside_article: bool) -> tuple[float, float]:
    """What an element says of the blocks inside it, and which part of it does not count for a wrapper."""
    says = 0.0 if tag == "header" and inside_article else ELEMENTS.get(tag, 0.0)
    against = says if tag in WRAPPERS else 0.0
    names = {p.lower() for m in NAMES.finditer(attributes) for p in PARTS.findall(m[1] or m[2] or m[3] or "")} if "=" in attributes else set()
    if names:
        good, bad = names & GOOD_NAMES, names & BAD_NAMES
        if good and tag in ("body", "html"):
            good = set()
        if bad - ({"header", "tags"} if good or inside_article else set()) and tag not in ("body", "html", "article", "main"):
            says += BAD_NAME
            against += BAD_NAME
        elif good:
            says += GOOD_NAME
    return says, against


def _unwrap(found: list[Block]) -> None:
    """Takes from the blocks what wrappers say against them, from the outermost element to the innermost.

    Elements that hold most of the text lie in each other, so one pass outside in is enough.
    """
    nodes: dict[int, tuple] = {}
    inside: Counter[int] = Counter()
    for block in found:
        node = block.against
        if node:
            inside[node[0]] += len(block.text)
        while node and node[0] not in nodes:
            nodes[node[0]] = node
            node = node[2]
    for number in sorted(nodes, reverse=True):
        if nodes[number][2]:
            inside[nodes[number][2][0]] += inside[number]
    size = sum(len(b.text) for b in found)
    large = [n for n in sorted(nodes) if inside[n] > MOST * size]
    within = {n: k for k, n in enumerate(large, 1)}  # how many of the large elements an element lies in
    for number in sorted(nodes):
        if number not in within:
            within[number] = within[nodes[number][2][0]] if nodes[number][2] else 0
    groups: list[list[Block]] = [[] for _ in range(len(large) + 1)]
    for block in found:
        groups[within[block.against[0]] if block.against else 0].append(block)
    outside, undone = 0, 0.0
    for group, number in zip(groups, [*large, None]):
        for block in group:
            block.around -= undone
            outside += len(block.text) if block.score() > 0 else 0
        if number is not None and outside < LEFT * inside[number]:
            undone += nodes[number][1]


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order; scripts, styles, form controls, comments and the head have none."""
    found: list[Block] = []
    root = (0, None, 0, "")
    # tag, number, sum of what elements say, inside an article, elements that may be wrappers, block-level place
    stack: list[tuple[str, int, float, bool, tuple | None, tuple]] = [("", 0, 0.0, False, None, root)]
    opened: Counter[str] = Counter()
    readers: tuple[int, tuple] | None = None  # where in the stack the element lies whose rest is by readers
    parts: list[str] = []
    linked = links = number = 0
    in_head = False

    def flush() -> None:
        nonlocal linked, readers
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text and not in_head:
                _, _, around, inside, against, place = stack[-1]
                if readers and (len(stack) <= readers[0] or stack[readers[0]][5] is not readers[1]):
                    readers = None
                if place[3] in HEADINGS and not inside:
                    if readers and place[1] is readers[1]:
                        readers = None
                    if COMMENTS.fullmatch(text):
                        k = len(stack) - 1
                        while stack[k][5] is place:
                            k -= 1
                        readers = (k, stack[k][5])
                found.append(Block(text, min(linked, len(text)), around + (BAD_NAME if readers else 0.0), place, inside, against))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    at, size = 0, len(html)
    while at < size:
        match = TOKEN.search(html, at)
        if match is None:
            add(html[at:])
            break
        if match.start() > at:
            add(html[at:match.start()])
        at, tag = match.end(), match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not match[1]:
            if tag in RAW and not match[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*+[^>]*+(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if tag == "head":
                in_head = True
            elif tag in BLOCK:
                flush()
                in_head = in_head and tag == "html"
                _close(stack, opened, "p", {"button", "table", "td", "th", "caption"})
                if tag in ("li", "dd", "dt", "tr", "td", "th"):
                    _close(stack, opened, tag, {"ul", "ol", "dl", "table", "menu", "tr"} - {tag})
            elif tag == "br":
                parts.append(" ")
            if tag == "a":
                links += 1
            if tag not in VOID and not match[3].endswith("/"):
                number += 1
                top = stack[-1]
                says, against = _element(tag, match[3], top[3])
                place = (number, top[5], top[5][2] + 1, tag) if tag in BLOCK else top[5]
                stack.append((tag, number, top[2] + says, top[3] or tag == "article", (number, against, top[4]) if against else top[4], place))
                opened[tag] += 1
        else:
            if tag == "head":
                parts.clear()
                in_head = False
            elif tag in BLOCK:
                flush()
            if tag == "a" and links:
                links -= 1
            _close(stack, opened, tag, {"table", "body"} - {tag} if tag not in ("html", "body") else set())
    flush()
    _unwrap(found)
    return found


def _close(stack: list, opened: Counter[str], tag: str, walls: set[str]) -> None:
    """Closes the nearest open ``tag`` and all inside it, unless one of ``walls`` stands between."""
    if not opened[tag]:
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] == tag:
            opened.subtract(e[0] for e in stack[k:])
            del stack[k:]
            return
        if stack[k][0] in walls:
            return


def minimum_cut(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it stays with the source in a minimum cut.

    ``gain``: capacity from the source if positive, to the sink if negative; ``ties``:
    (a, b, capacity) both ways. Of several minimum cuts the one with the smallest
    source side is given. Dinic's blocking flows, without recursion.
    """
    source, sink = len(gain), len(gain) + 1
    to, room, out = [], [], [[] for _ in range(len(gain) + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            edge(source, i, g, 0.0)
        elif g < 0:
            edge(i, sink, -g, 0.0)
    for a, b, c in ties:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(len(gain))]
        tried = [0] * len(out)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                keep = next(k for k, e in enumerate(path) if room[e] <= tiny)
                at = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] > tiny and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(out[at]):
                path.append(e)
                at = to[e]
            elif path:
                at = to[path.pop() ^ 1]
                tried[at] += 1
            else:
                break


def _steps(a: tuple, b: tuple) -> int:
    """Steps in the tree from one place to the other. Blocks are in page order, so all steps
    between neighbours together go over each element at most twice."""
    steps = 0
    while a is not b:
        if a[2] >= b[2]:
            a, steps = a[1], steps + 1
        else:
            b, steps = b[1], steps + 1
    return steps


def tied(found: list[Block]) -> list[tuple[int, int, float]]:
    """Ties between blocks: to the next one, and to the next one within the same parent."""
    ties, last = [], {}
    for i, block in enumerate(found):
        share = BREAK if block.heading else 1.0
        if i:
            ties.append((i - 1, i, share * NEXT / (1 + _steps(found[i - 1].place, block.place))))
        parent = block.place[1][0] if block.place[1] else 0
        if last.get(parent, i - 1) != i - 1:
            ties.append((last[parent], i, share * SIBLING))
        last[parent] = i
    return ties


def main_text(html: str | None) -> str:
    """The content blocks of a page joined by line breaks; empty for a null or empty page."""
    found = blocks(html) if html else []
    kept = minimum_cut([b.score() for b in found], tied(found)) if found else []
    return "\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(html: Column) -> Column:
    """The main text of ``html`` as a column; never null, and nothing of it is cut."""
    import pyarrow as pa

    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()) for p in pages], pa.string())

    texts.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(texts, "string")(html)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with text and n_chars (code points of text). Columns of
    these two names are replaced; a null or empty page has an empty text; every row stays."""
    rows = pages.withColumn("text", extract(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))
    return rows.drop(html)
