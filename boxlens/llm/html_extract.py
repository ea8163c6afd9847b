"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at block-level tags. A linear classifier on
each block's place and shape (enclosing elements, class and id names, length,
link share, punctuation) gives its cost of being content or boilerplate; a name
that ends in a word of boilerplate weighs much, one that only holds it little, and
names of a state (``has-sidebar``) nothing; these
costs are the capacities to the two terminals. Smoothness edges join blocks that
follow one another, and blocks of one parent or grandparent element through a
node for that element. The minimum cut, found by maximum flow, labels the
blocks; the content blocks are the text. Nodes whose own cost outweighs all
their edges are labelled at once and folded into their neighbours, which keeps
the cut exact and leaves little for the flow.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z|[a-z])", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style svg annotation annotation-xml title textarea xmp iframe noembed noframes".split())
SILENT = frozenset("script style svg annotation annotation-xml".split())  # of these, those inside a line of text
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom menclose mfenced msub msup msubsup "
    "munder mover munderover mtable mtr mtd".split())
NEVER = frozenset("nav aside footer form head script style noscript template select button dialog menu object audio video canvas".split())
CLOSES = {  # elements that an opening tag ends, and those beyond which it does not look
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
# words of class, id and role that mark boilerplate and content
AGAINST = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside rail ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe signup social share sharing related recommended recommendations comment "
    "comments disqus reply replies respond discussion form login search widget toolbar pagination pager legal copyright "
    "disclaimer skip complementary contentinfo".split())
FOR = frozenset("article content main post entry story body text prose".split())
# nouns of layout: the word before them tells what a name is about
LAYOUT = frozenset(
    "area articles bar block body box button buttons col column container content group holder info inner item items law left "
    "link links list message outer panel policy posts prompt right row section slot stories text unit wrap wrapper".split())
STATES = frozenset("has hide is no not show toggle with without".split())

# the classifier: a block's log-odds of being content
BASE, PER_WORD, WORDS, LINKS = -0.8, 0.08, 30, -4.0
INSIDE, NAMED, MARKED, HINTED, OUTSIDE_HEADER = 2.5, 1.0, -8.0, -0.8, -8.0
PARAGRAPH, HEADING, ITEM, SENTENCE, RIGHTS = 0.6, 0.4, -0.3, 0.7, -2.5
# smoothness: blocks in a row (by common parent, grandparent, none), and by DOM node
NEXT = (1.0, 0.5, 0.1)
PARENT, GRANDPARENT = 0.5, 0.2
BARRED = 1e9
RIGHTS_RE = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)

IN_CONTENT, IS_NAMED, IS_MARKED, IS_BARRED, IN_HEADER, IS_HINTED = 1, 2, 4, 8, 16, 32


class Block:
    __slots__ = ("flags", "grandparent", "links", "parent", "tag", "text")

    def __init__(self, text: str, links: int, tag: str, flags: int, parent: int, grandparent: int):
        self.text, self.links, self.tag = text, links, tag
        self.flags, self.parent, self.grandparent = flags, parent, grandparent


def evidence(name: str) -> int:
    """What one class, id or role name says of its element."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in STATES and len(words) > 1:
        return 0
    if AGAINST.isdisjoint(words):
        return IS_NAMED if not FOR.isdisjoint(words) else IN_HEADER if "header" in words else 0
    while len(words) > 1 and (words[-1] in LAYOUT or words[-1].isdigit()):
        words.pop()
    return IS_MARKED if words[-1] in AGAINST else IS_HINTED


def _flags(tag: str, attributes: str, above: int) -> int:
    flags = above
    if tag in NEVER:
        return flags | IS_BARRED
    if tag in ("article", "main"):
        flags |= IN_CONTENT
        if tag == "main":  # no page has its main part inside a side part
            flags &= ~(IS_MARKED | IS_HINTED | IN_HEADER)
    elif tag == "header" and not above & IN_CONTENT:
        flags |= IN_HEADER
    if attributes and tag not in ("html", "body"):
        said = 0
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                return flags | IS_BARRED
            if name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    return flags | IS_BARRED
            else:
                for one in value.split():
                    said |= evidence(one)
        if said & IN_HEADER and (above & IN_CONTENT or said & (IS_NAMED | IS_MARKED)):
            said &= ~IN_HEADER
        if said & IS_MARKED:
            said = IS_MARKED
        elif said & IS_NAMED:
            said &= ~IS_HINTED
        flags |= said
    return flags


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order, with the place of each in the tree."""
    blocks: list[Block] = []
    parts: list[str] = []
    links = link_at = 0
    in_link = False
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, flags, number of the element
    elements = at = 0
    size = len(html)

    def end_block() -> None:
        nonlocal links, link_at
        if parts:
            if in_link:
                links += sum(map(len, parts[link_at:]))
            text = " ".join(unescape("".join(parts)).split())
            if text:
                tag, flags, me = stack[-1]
                up = stack[-2][2] if len(stack) > 1 else 0
                # the parent of a paragraph's text is what holds the paragraph
                over = stack[-3][2] if len(stack) > 2 else 0
                blocks.append(Block(text, links, tag, flags, up, over) if tag in _LEAVES else Block(text, links, tag, flags, me, up))
            parts.clear()
        links = link_at = 0

    def close(names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "a":
                if in_link:
                    links += sum(map(len, parts[link_at:]))
                in_link = False
            elif tag not in INLINE and tag not in VOID and tag not in SILENT:
                end_block()
                close((tag,), ())
            continue
        name = m[2] or m[4]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[5] or ""
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            if in_link:
                links += sum(map(len, parts[link_at:]))
            in_link, link_at = True, len(parts)
        elif tag in RAW:
            if tag not in SILENT:
                end_block()
            elif attributes.endswith("/") and tag == "svg":
                continue
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else size
        elif tag in INLINE:
            continue
        elif tag in VOID:
            if tag == "hr":
                end_block()
        else:
            end_block()
            if tag in CLOSES:
                close(*CLOSES[tag])
            else:
                close(("p",), _SCOPES)
            elements += 1
            stack.append((tag, _flags(tag, attributes, stack[-1][1]), elements))
            in_link = False
    end_block()
    return blocks


_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
_SCOPES = ("article", "aside", "body", "button", "div", "fieldset", "footer", "header", "li", "main", "nav", "section", "table", "td", "th", "blockquote", "dd")


def content_cost(block: Block) -> float:
    """The classifier's log-odds that a block is content."""
    if block.flags & IS_BARRED:
        return -BARRED
    text = block.text
    z = BASE + PER_WORD * min(text.count(" ") + 1, WORDS) + LINKS * min(1.0, block.links / len(text))
    if block.flags & IN_CONTENT:
        z += INSIDE
    if block.flags & IS_NAMED:
        z += NAMED
    if block.flags & IS_MARKED:
        z += MARKED
    if block.flags & IS_HINTED:
        z += HINTED
    if block.flags & IN_HEADER:
        z += OUTSIDE_HEADER
    if block.tag == "p":
        z += PARAGRAPH
    elif block.tag[:1] == "h" and block.tag[1:].isdigit():
        z += HEADING
    elif block.tag == "li":
        z += ITEM
    if text[-1] in ".!?…\"”»":
        z += SENTENCE
    if len(text) < 200 and RIGHTS_RE.search(text):
        z += RIGHTS
    return z


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    ``cost``: capacity from the source if positive, to the sink if negative;
    ``edges``: undirected, with capacities.
    """
    n = len(cost)
    cost = list(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node that outweighs its edges is settled; its edges become its neighbours' costs
        i = todo.popleft()
        if side[i] is not None or abs(cost[i]) < sum(near[i].values()):
            continue
        side[i] = cost[i] >= 0
        for j, w in near[i].items():
            cost[j] += w if side[i] else -w
            del near[j][i]
            if side[j] is None:
                todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        for i, s in zip(rest, _max_flow(rest, cost, near), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _max_flow(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's maximum flow on what is left; which nodes the source still reaches."""
    number = {v: k for k, v in enumerate(nodes)}
    n = len(nodes)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to)), to.append(b), room.append(forth)
        out[b].append(len(to)), to.append(a), room.append(back)

    for v in nodes:
        if cost[v] > 0:
            arc(source, number[v], cost[v], 0.0)
        elif cost[v] < 0:
            arc(number[v], sink, -cost[v], 0.0)
        for u, w in near[v].items():
            if v < u:
                arc(number[v], number[u], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                while path and room[path[-1]] <= tiny or any(room[e] <= tiny for e in path):
                    path.pop()
                a = to[path[-1]] if path else source
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                turn[a] += 1


def label(blocks: list[Block]) -> list[bool]:
    n = len(blocks)
    cost = [content_cost(b) for b in blocks]
    edges: list[tuple[int, int, float]] = []
    hubs: dict[int, int] = {}

    def hub(element: int) -> int:
        if element not in hubs:
            hubs[element] = n + len(hubs)
            cost.append(0.0)
        return hubs[element]

    for k, b in enumerate(blocks):
        if k:
            a = blocks[k - 1]
            close = 0 if a.parent == b.parent else 1 if a.grandparent == b.grandparent or a.parent == b.grandparent or a.grandparent == b.parent else 2
            edges.append((k - 1, k, NEXT[close]))
        edges.append((k, hub(b.parent), PARENT))
        if b.grandparent:
            edges.append((k, hub(b.grandparent), GRANDPARENT))
    return minimum_cut(cost, edges)[:n]


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by newlines; empty if there is none."""
    if not html:
        return ""
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages (page_id,
    url, html, ..)``.

    Null and empty html give the empty text, and so does a page without content.
    Null ids and urls stay null, repeated rows give a row each, other columns
    are ignored, an empty table gives none. Pages of any length are read whole; a
    page is held in memory. Costs that tie are content. Character references are decoded,
    white space inside a block is one space, blocks are joined by one newline.
    """
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    ).mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
