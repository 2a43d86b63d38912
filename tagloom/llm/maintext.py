"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text. A linear classifier gives each block a cost of being called
content and a cost of being called boilerplate; these become the capacities of its edges to
the two terminals. Neighbouring blocks, and blocks that follow one another in the same element, are joined
by edges whose capacity falls with their distance in the DOM, so that a short paragraph goes
with its neighbours. A maximum flow gives the cheapest labelling of all blocks together.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: elements of HTML that begin a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option p pre search section select summary table tbody td tfoot th thead tr ul "
    "textarea head title noscript iframe optgroup".split()
)
#: Fixed: elements whose content is no markup or no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg annotation annotation-xml".split())
#: Fixed: elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed: what ends an open paragraph, list item, cell and so on, by the element that begins.
IMPLIED = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "body": {"head"},
}
#: Elements that never hold main text.
OUTSIDE = frozenset(
    "nav footer aside form select noscript dialog menu head option iframe fieldset search".split()
)
#: Elements that mark it.
INSIDE = frozenset(("article", "main"))
#: Words of class, id and role that say what an element is for.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs cc "
    "comment comments commentlist commenting consent contentinfo cookie cookies copyright disclaimer "
    "discussion disqus dialog footer form gdpr login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification pager paginator pagination popup prefooter privacy promo promoted "
    "promotion recommended recommendations related replies reply respond search share sharing sidebar signup "
    "social sponsor sponsored sponsors subscribe subscription tags toolbar topbar trending widget widgets".split()
)
GOOD_WORDS = frozenset("article articlebody body content entry hentry main post story text page".split())
#: A class such as has-sidebar, or the rest of content-with-sidebar, speaks of another element.
ABOUT_OTHERS = frozenset("has with no without layout is col".split())
#: On an element that is named as content, classes such as category-social speak of its subject.
SUBJECT = frozenset("category cat tag topic format type status".split())

#: Weights of the classifier; above 0 speaks for content.
BIAS = -1.6
PER_DOUBLING = 0.55  # of the number of words
SENTENCE_END = 0.6
PARAGRAPH = 0.5
HEADING = 0.8
IN_MAIN = 4.0
GOOD_NAME = 1.2
BAD_NAME = -6.0  # for each element above, and at most MOST_NAMES of them
MOST_NAMES = 9
LINK_SHARE = -4.0
LINK_SHARE_IN_MAIN = -2.0  # an article's list of sources is all links
IN_A_RUN = 0.8  # one of RUN paragraphs or more beside one another, on a page that marks no main text
RUN = 3
CERTAIN = 1000.0
#: Capacity between neighbours in one element, and between blocks that follow in it with others between.
NEXT = 1.2
SAME_PARENT = 0.6

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(
    r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE
)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def spoken(words: list[str]) -> tuple[bool, bool]:
    """Whether the words of a class or id call their element content, and whether boilerplate; the last one decides."""
    own = words[: next((k for k, w in enumerate(words) if k and w in ("with", "has", "no", "without")), None)]
    good = any(w in GOOD_WORDS for w in own)
    if not own or own[0] in ABOUT_OTHERS:
        return good, False
    last = next((w for w in reversed(own) if w in GOOD_WORDS or w in BAD_WORDS), "")
    bad = last in BAD_WORDS or ("header" in own and not good)
    return good and not bad, bad


class Element:
    __slots__ = ("name", "parent", "depth", "outside", "inside", "good", "bad", "last")

    def __init__(self, name: str, parent: Element | None, attributes: str) -> None:
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.outside = parent.outside if parent else False
        self.inside = parent.inside if parent else False
        self.good = parent.good if parent else False
        self.bad = parent.bad if parent else 0  # elements up from here whose names speak of boilerplate
        self.last = -1  # the last block below this element
        named: list[tuple[list[str], bool, bool]] = []
        excluded = False
        if attributes and "=" in attributes:
            for m in _NAMED.finditer(attributes):
                for token in (m[2] or m[3] or m[4] or "").split():
                    words = _WORD.findall(_CAMEL.sub(" ", token).lower())
                    named.append((words, *spoken(words)))
                    excluded = excluded or (m[1].lower() == "role" and named[-1][2])
            excluded = excluded or bool(_HIDDEN.search(attributes))
        own = name in INSIDE or any(good for _, good, _ in named)
        bad = any(b and not (own and len(w) > 1 and w[0] in SUBJECT) for w, _, b in named) and name not in ("html", "body")
        # An article's own header holds its title; a page's header does not.
        if name in OUTSIDE or (name == "header" and not self.inside) or (excluded and name not in ("html", "body")):
            self.outside = True
        elif bad:  # against an article around it, or the article that it is
            self.inside = name in INSIDE and not self.bad
            self.good = False
            self.bad += 1
        elif name in INSIDE:  # against one name around it
            self.inside = True
            self.bad = max(0, self.bad - 1)
        self.good = self.good or any(good for _, good, _ in named)


class Block:
    __slots__ = ("text", "links", "element", "tag", "bad", "run")

    def __init__(self, text: str, links: int, element: Element, tag: str) -> None:
        self.text, self.links, self.element, self.tag = text, links, element, tag
        self.bad = element.bad
        self.run = False


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order, with blanks collapsed and references decoded.

    Elements within a line, formulas and labels among them, do not part it; the caption of a button is no text of the page.
    """
    root = Element("", None, "")
    stack, found = [root], []
    text: list[str] = []
    linked = anchors = 0
    button = False

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                found.append(Block(whole, linked, stack[-1], stack[-1].name))
            text, linked = [], 0

    def add(part: str) -> None:
        nonlocal linked
        if part and not button:
            text.append(part)
            if anchors:
                linked += len(part.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "a":
                anchors = max(0, anchors - 1)
            elif name == "button":
                button = False
            elif name in BLOCKS:
                flush()
                button = False  # one that was never closed ends with what it stands in
                anchors = 0 if name in ("li", "p", "div", "nav", "td") else anchors
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
            continue
        if name in RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            anchors = 1  # links do not nest
        elif name == "button":
            add(" ")
            button = True
        elif name in BLOCKS:
            flush()
            if name == "hr":
                continue
            if stack[-1].name == "p":  # a block ends an open paragraph
                stack.pop()
            if name in IMPLIED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in IMPLIED[name]:
                        del stack[k:]
                        break
                    if stack[k].name in ("ul", "ol", "dl", "table", "select", "nav", "div", "article"):
                        break
            stack.append(Element(name, stack[-1], attributes))
    flush()
    # Names around all text that could be content set nothing apart.
    around = min((b.bad for b in found if not b.element.outside and evidence(b) > 0), default=0)
    for block in found:
        block.bad = min(MOST_NAMES, max(0, block.bad - around))
    if not any(b.element.inside for b in found):
        _mark_runs(found)
    return found


def _mark_runs(found: list[Block]) -> None:
    """Marks paragraphs of one parent that follow one another without a link: verse, dialogue, lines of a letter."""
    start = 0
    for k in range(len(found) + 1):
        first = found[start] if start < len(found) else None
        if k < len(found) and found[k].tag == "p" and not found[k].links and first is not None:
            if first.tag == "p" and not first.links and found[k].element.parent is first.element.parent:
                continue
        if k - start >= RUN:
            for block in found[start:k]:
                block.run = True
        start = k


def evidence(block: Block) -> float:
    """What the block's text and element say for content."""
    words = block.text.count(" ") + 1
    share = min(1.0, block.links / max(1, len(block.text)))
    weight = LINK_SHARE_IN_MAIN if block.element.inside else LINK_SHARE
    out = BIAS + PER_DOUBLING * math.log2(1 + words) + weight * share + IN_A_RUN * block.run
    out += SENTENCE_END * (block.text[-1] in ".!?…。\"'”»")
    out += PARAGRAPH * (block.tag in ("p", "pre", "blockquote")) + HEADING * (block.tag in _HEADINGS)
    e = block.element
    return out + IN_MAIN * e.inside + GOOD_NAME * (e.good and not e.inside)


def cost(block: Block) -> float:
    """What it costs to call the block boilerplate rather than content."""
    return -CERTAIN if block.element.outside else evidence(block) + BAD_NAME * block.bad


def distance(a: Element, b: Element) -> int:
    """Number of steps between two elements in the DOM."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.parent:
            a = a.parent
        elif b.parent:
            b = b.parent
        steps += 1
    return steps


class Flow:
    """Maximum flow by shortest augmenting paths in phases; nodes 0 and 1 are the terminals."""

    def __init__(self, n: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.left: list[float] = []

    def join(self, a: int, b: int, there: float, back: float) -> None:
        for x, y, capacity in ((a, b, there), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.left.append(capacity)

    def levels(self) -> list[int]:
        level = [-1] * len(self.edges)
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.left[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def run(self) -> list[bool]:
        """Which nodes are on the side of node 0 of a minimum cut."""
        while True:
            level = self.levels()
            if level[1] < 0:
                return [x >= 0 for x in level]
            tried = [0] * len(self.edges)
            path: list[int] = []
            a = 0
            while True:
                if a == 1:
                    most = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= most
                        self.left[e ^ 1] += most
                    k = next(i for i, e in enumerate(path) if self.left[e] <= 1e-9)
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while tried[a] < len(self.edges[a]):
                    e = self.edges[a][tried[a]]
                    if self.left[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    a = self.to[path.pop() ^ 1]
                    tried[a] += 1
                    continue
                path.append(e)
                a = self.to[e]


def labels(found: list[Block]) -> list[bool]:
    """Which blocks are content. Blocks that are certain are terminals, not nodes of the flow."""
    flow = Flow(len(found))
    free = []
    for i, block in enumerate(found):
        c = cost(block)
        free.append(c > -CERTAIN)
        if c > 0:
            flow.join(0, i + 2, c, 0)
        elif free[i]:
            flow.join(i + 2, 1, -c, 0)

    def smooth(i: int, j: int, capacity: float) -> None:
        if free[i] and free[j] and (found[i].bad > 0) == (found[j].bad > 0):
            flow.join(i + 2, j + 2, capacity, capacity)
        # Beside boilerplate by element or name a block loses nothing: adverts stand within articles.

    for j, block in enumerate(found):
        if j:
            smooth(j - 1, j, NEXT / (1 + distance(found[j - 1].element, block.element) / 2))
        parent = block.element.parent or block.element
        if 0 <= parent.last < j - 1:
            smooth(parent.last, j, SAME_PARENT)
        parent.last = j
    side = flow.run()
    return [free[i] and side[i + 2] for i in range(len(found))]


def main_text(page: str | None) -> str:
    """The blocks that are content, one a line."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, type=pa.string())], names=["id", "text"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """<id>, text of every row of ``pages``, without a shuffle.

    A null or empty page, and one without main text, gets an empty text. Damaged markup is read
    as far as it goes; an element that is never closed ends with the page. A page of any length is read whole. Ids pass through,
    repeated and null ones, too. An empty table gives an empty result. Other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return (
        pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string"))
        .mapInArrow(_extract, f"id {kind}, text string")
        .withColumnRenamed("id", id_col)
    )
