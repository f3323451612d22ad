"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks in page order.  Every block gets two classifier
costs, that of being called content and that of being called boilerplate, which become
capacities to the two terminals; neighbours in page order and blocks of one parent are
joined by smoothness edges, which weaken as their link shares part.  Text length, link share,
element names and words of class, id and role add to the costs, and so does standing outside the
elements that hold the page's main text; only the text of elements that never hold it
(``SURE_TAGS``) is decided beforehand.  The minimum cut of this graph is the labelling of
least total cost, found by max-flow.  Pages are independent, so this is one pass without
a shuffle; the work per page grows with its blocks.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import fresh, without

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split())
#: Blocks that stand in a row under one parent.
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th pre figcaption summary option legend".split())
#: Elements whose text is never main text.
SURE_TAGS = frozenset("aside button dialog footer head menu nav search select".split())
#: Elements and words of class, id and role that speak for one label.
BOILER_TAGS = frozenset("form header".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies dialog discussion disqus feedback footer form gdpr guestbook header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion reactions "
    "recommended related replies reply respond responses search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget".split())
CONTENT_WORDS = frozenset("article body content entry main post story".split())
#: What follows such a word in a class name is not what the element is ("has-sidebar", "no-comments").
_ABOUT_OTHERS = frozenset("has hide hides no show shows with without".split())
_WORDS_IGNORED_ON = frozenset("html body main article".split())

# Capacities.
SURE = 100_000
#: Of being called what an element's name or class words speak against.
CONTENT_TAG, WORDS = 300, 60
#: Of calling doubtful text content on a page that has other main text, and what is added at most, by that text's share of the page.
ELSEWHERE, OUTSIDE = 150, 100
#: Characters of unlinked text from which a block of no side counts as such.
PLAIN_TEXT = 100
PARENT_EDGE = 40
NEIGHBOUR_EDGE = 15

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^'"<>])*|[^>]*)>|[^<]+|<""", re.S)
#: The same behind the last ">", where no tag can end: without it each "<" would be read to the end of the page.
_TAIL = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Block:
    """Text of one block with the index of its parent element, its side and link characters.

    The side is above 0 for content, below 0 for boilerplate, 0 if unknown; its size is the cost of the other label.
    """

    __slots__ = ("links", "parent", "parts", "side", "text")

    def __init__(self, parent: int, side: int):
        self.parent, self.side, self.parts, self.links, self.text = parent, side, [], 0, ""


def _speaks(name: str) -> int:
    """What one class name, id or role says: -1, 0 or 1."""
    words: set[str] = set()
    for word in re.findall(r"[a-z]+", name):
        if word in _ABOUT_OTHERS:
            break
        words.add(word)
    return -1 if words & BOILER_WORDS else 1 if words & CONTENT_WORDS else 0


def _side(tag: str, attributes: str) -> int:
    """What an element's name and attributes say of its text; 0: nothing, or as much for as against."""
    if tag in SURE_TAGS:
        return -SURE
    if tag in CONTENT_TAGS:
        return CONTENT_TAG
    if tag in BOILER_TAGS:
        return -WORDS
    if tag in _WORDS_IGNORED_ON:
        return 0
    said = {name: _speaks(name) for _, value in _ATTRIBUTE.findall(attributes) for name in value.strip("\"'").lower().split()}
    total = sum(said.values())
    return WORDS if total > 0 else -WORDS if total < 0 else 0


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order.

    Unclosed paragraphs and items end where a block begins; a stray end tag is ignored;
    an element that is never closed ends with its parent.  The innermost element that
    says something decides a block's side.
    """
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, element number, side, inside a link
    out: list[Block] = []
    now: Block | None = None
    number, at, end, last = 0, 0, len(page), page.rfind(">")

    while at < end:
        token = (_TOKEN if at < last else _TAIL).match(page, at)
        at = token.end()
        piece, tag = token.group(0), (token.group(2) or "").lower() if token.re is _TOKEN else ""
        if not tag:
            if piece[0] != "<" or piece == "<":
                if now is None:
                    homes = (e for e in reversed(stack) if e[0] in BLOCK or not e[0])
                    inner = next(homes)
                    home = next(homes) if inner[0] in LEAF else inner
                    now = Block(home[1], inner[2])
                    out.append(now)
                now.parts.append(piece)
                if stack[-1][3]:
                    now.links += len(piece)
            continue
        if tag in BLOCK:
            now = None
        if token.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth][0] in BLOCK:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            continue
        if tag == "br" and now is not None:
            now.parts.append(" ")
        if tag in VOID or token.group(3).endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK:
            closes = ("p",) if tag not in ("li", "dt", "dd", "option", "tr", "td", "th") else ("p", tag)
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closes:
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCK:
                    break
        number += 1
        said = _side(tag, token.group(3))
        stack.append((tag, number, said or stack[-1][2], stack[-1][3] or tag == "a"))

    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def _linked(block: Block) -> float:
    """Share of a block's text that lies in links."""
    return min(1.0, block.links / len(block.text))


def costs(block: Block, elsewhere: int) -> tuple[int, int]:
    """(cost of calling it content, cost of calling it boilerplate); ``elsewhere``: what other main text of the page adds to the first."""
    linked = _linked(block)
    content = round(200 * linked) + max(0, -block.side) + (elsewhere if block.side <= 0 else 0)
    return content, round((20 + min(len(block.text), 300) / 2) * (1 - linked)) + max(0, block.side)


def min_cut(costs_: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for nodes labelled content in a minimum cut (of equal cuts, the one with most content).

    ``edges`` are (i, j, capacity) in both directions.  What a node could send straight
    through, or over one edge, is cancelled first; the rest is augmented along shortest paths.
    """
    n = len(costs_)
    excess = [boiler - content for content, boiler in costs_]  # above 0: tied to the content terminal
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, c in edges:
        near[i].append(len(to))
        near[j].append(len(to) + 1)
        to += [j, i]
        room += [c, c]
    for e in range(len(to)):
        i, j = to[e ^ 1], to[e]
        if excess[i] > 0 > excess[j] and (flow := min(excess[i], -excess[j], room[e])) > 0:
            excess[i] -= flow
            excess[j] += flow
            room[e] -= flow
            room[e ^ 1] += flow
    while True:
        # breadth first from all nodes with spare flow to the nearest node that still takes some
        came = [-2] * n
        queue = deque(k for k in range(n) if excess[k] > 0)
        for k in queue:
            came[k] = -1
        goal = -1
        while queue and goal < 0:
            i = queue.popleft()
            for e in near[i]:
                j = to[e]
                if room[e] > 0 and came[j] == -2:
                    came[j] = e
                    if excess[j] < 0:
                        goal = j
                        break
                    queue.append(j)
        if goal < 0:
            break
        path, k = [], goal
        while came[k] >= 0:
            path.append(came[k])
            k = to[came[k] ^ 1]
        flow = min(excess[k], -excess[goal], min(room[e] for e in path))
        excess[k] -= flow
        excess[goal] += flow
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    # boilerplate: whatever can still send flow to the boilerplate terminal
    boiler = [x < 0 for x in excess]
    queue = deque(k for k in range(n) if boiler[k])
    while queue:
        j = queue.popleft()
        for e in near[j]:
            i = to[e]
            if room[e ^ 1] > 0 and not boiler[i]:
                boiler[i] = True
                queue.append(i)
    return [not b for b in boiler]


def graph(parts: list[Block]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Costs and smoothness edges of a page.

    Text of no side costs more to keep the more of the page's unlinked text stands in elements that
    speak for content: beside a whole article it is taken for something else (reader comments, say)
    at any length, beside a teaser it is not.  An edge's capacity falls with the difference of the
    two link shares, so rows of links between short paragraphs do not take these with them.
    """
    own = [len(b.text) * (1 - _linked(b)) for b in parts]
    named = sum(n for n, b in zip(own, parts) if b.side > 0)
    found = any(b.side > 0 for b in parts)
    outside = found * (ELSEWHERE + round(OUTSIDE * named / max(1, sum(n for n, b in zip(own, parts) if b.side >= 0))))
    plain = found or any(b.side == 0 and n >= PLAIN_TEXT for n, b in zip(own, parts))

    def edge(i: int, j: int, capacity: int) -> tuple[int, int, int]:
        return i, j, round(capacity * (1 - abs(_linked(parts[i]) - _linked(parts[j]))))

    edges, last = [], {}
    for k, b in enumerate(parts):
        if k:
            edges.append(edge(k - 1, k, NEIGHBOUR_EDGE))
        if (before := last.get(b.parent)) is not None:
            edges.append(edge(before, k, PARENT_EDGE // (k - before)))
        last[b.parent] = k
    return [costs(b, max(outside, ELSEWHERE * plain) if b.side < 0 else outside) for b in parts], edges


def main_text(page: str | None) -> str:
    parts = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(parts, min_cut(*graph(parts))) if keep)


def extract(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text (``out``) and ``n_chars`` to every page; columns of these names are replaced.

    A null or empty page, or one that is all boilerplate, has an empty text.
    """
    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    made = fresh(df, "__text")
    rows = without(df.withColumn(made, text_of(F.col(page))), out, "n_chars")
    return rows.withColumnRenamed(made, out).withColumn("n_chars", F.length(out).cast("long"))
