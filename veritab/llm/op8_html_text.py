"""Operator 8: main text of web pages by minimum-cut labelling.

A page is read into blocks of text with the elements around them. A linear classifier gives each
block a cost for either label: the elements it stands in, words of their class and id, the share
of its text in links, its length. The costs become capacities to two terminals; blocks that
follow each other, and blocks under one parent, are joined by edges that get weaker with their
distance in the document tree. The maximum flow separates content from boilerplate; a short
paragraph between paragraphs stays, a lone sentence in a sidebar goes.

Weights are fixed values set by hand: there are no labelled pages to train on. Text that no reader
sees as prose (scripts, styles, forms, hidden parts) never becomes a block.

Pages are independent rows; nothing is shuffled.

Defined results: null, empty or tagless html gives its text, if any, as one block; unclosed and
crossed elements end where an enclosing element or the page ends; a page of any depth takes time in proportion to its length; repeated rows are read one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

# Elements by what they mean for the text in them, and words of class and id names.
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas form button select option textarea input label".split())
RAW_TEXT = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements that do not end a block, whether their own text is seen or not.
PHRASING = INLINE | frozenset("script style noscript template svg math iframe object canvas button select option textarea input label".split())
CLOSES_P = re.compile(r"address|article|aside|blockquote|div|dl|fieldset|figure|footer|form|h[1-6]|header|hr|main|nav|ol|p|pre|section|table|ul")
FURNITURE = frozenset("nav footer aside menu dialog".split())
ARTICLE = frozenset("article main".split())
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|menu|navbar|(?<!with-)(?<!has-)(?<!no-)sidebar|footer|"
    r"breadcrumbs?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|related|"
    r"recommended|comments?|replies|disqus|responses|toolbar|pagination|pager|copyright)(?:$|[\s_-])"
)
DOUBTFUL_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navigation|side|masthead|header|topbar|social|discussion|widgets?|tags?|legal|skip)(?:$|[\s_-])")
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|content|main|body|text)(?:$|[\s_-])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
GOOD_ROLE = frozenset({"main", "article"})
BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

# Cost weights (positive speaks for content) and edge strengths.
IN_ARTICLE, IN_FURNITURE, IN_BAD_NAME, IN_GOOD_NAME, OUTSIDE_ARTICLE = 6.0, -14.0, -14.0, 2.0, -7.0
LINK_SHARE, HEADING, PARAGRAPH, LIST_ITEM, WORD_GAIN, BIAS = -5.0, 0.5, 1.0, -0.5, 0.06, -0.5
ADJACENT, SIBLING = 1.0, 0.7

# A quote opens a value only after `=`; elsewhere a tag ends at its first `>`.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    unseen: bool
    article: bool
    furniture: bool
    bad: bool
    good: bool
    linked: bool = False
    owner: Element | None = None

    def __post_init__(self):
        """Text in inline elements belongs to the element around them, and is link text under an `a` among them."""
        inline = self.tag in INLINE and self.parent is not None
        self.owner = self.parent.owner if inline else self
        self.linked = inline and (self.tag == "a" or self.parent.linked)


@dataclass
class Block:
    text: str
    element: Element
    link_share: float


def _open(tag: str, attributes: str, parent: Element | None) -> Element:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|$|/)", attributes)) or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
    article = tag in ARTICLE or role in GOOD_ROLE
    page_header = tag == "header" and not (parent and parent.article)
    good = bool(GOOD_NAME.search(names))
    doubtful = bool(DOUBTFUL_NAME.search(names)) and not good and not (parent and parent.article)
    bad = (bool(BAD_NAME.search(names)) or doubtful) and tag not in ("html", "body", *ARTICLE)
    return Element(
        tag, parent, parent.depth + 1 if parent else 0,
        unseen=bool(parent and parent.unseen) or tag in UNSEEN or hidden,
        article=bool(parent and parent.article) or article,
        furniture=bool(parent and parent.furniture) or tag in FURNITURE or role in BAD_ROLE or page_header,
        bad=bool(parent and parent.bad) or bad,
        good=bool(parent and parent.good) or good,
    )


def read_blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    blocks: list[Block] = []
    here = root = Element("#page", None, 0, False, False, False, False, False)
    owner, parts, linked, whole = root, [], 0, 0
    opened: dict[str, list[Element]] = {}

    def flush() -> None:
        nonlocal parts, linked, whole
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            blocks.append(Block(text, owner, linked / max(whole, 1)))
        parts, linked, whole = [], 0, 0

    def say(text: str) -> None:
        nonlocal owner, linked, whole
        if not text or here.unseen:
            return
        if not parts:
            owner = here.owner
        parts.append(text)
        size = len(text.strip())
        whole += size
        linked += size if here.linked else 0

    def enter(element: Element) -> None:
        nonlocal here
        here = element
        opened.setdefault(element.tag, []).append(element)

    def leave(element: Element) -> None:
        """Close an open element with all that is open in it."""
        nonlocal here
        while here is not element.parent:
            opened[here.tag].pop()
            here = here.parent

    def inside(tag: str) -> Element | None:
        return opened[tag][-1] if opened.get(tag) else None

    place = 0
    while True:
        m = _TAG.search(page, place)
        if not m:
            say(page[place:])
            break
        say(page[place : m.start()])
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            match = inside(tag)
            if tag not in PHRASING:
                flush()
            if match:
                leave(match)
            continue
        if tag not in PHRASING:
            flush()
        if CLOSES_P.fullmatch(tag) and (p := inside("p")):
            leave(p)
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and here.tag == tag:
            leave(here)
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        enter(_open(tag, m[3] or "", here))
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\b", re.I).search(page, place)
            place = end.start() if end else len(page)
    flush()
    return blocks


def content_cost(block: Block, has_article: bool) -> float:
    """Log-odds of content, as far as the block alone tells."""
    at = block.element
    score = BIAS + min(len(block.text.split()), 80) * WORD_GAIN + LINK_SHARE * block.link_share
    if re.fullmatch(r"h[1-6]", at.tag):
        score += HEADING
    elif at.tag in ("#page", "p", "blockquote", "pre", "td", "figcaption"):
        score += PARAGRAPH
    elif at.tag == "li":
        score += LIST_ITEM
    if has_article:
        score += IN_ARTICLE if at.article else OUTSIDE_ARTICLE
    if at.good:
        score += IN_GOOD_NAME
    if at.furniture:
        score += IN_FURNITURE
    if at.bad:
        score += IN_BAD_NAME
    return score


def tree_distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Cut:
    """Minimum cut between source and sink by shortest augmenting paths in levels."""

    def __init__(self, nodes: int):
        self.to: list[list[int]] = [[] for _ in range(nodes + 2)]
        self.room: list[list[float]] = [[] for _ in range(nodes + 2)]
        self.back: list[list[int]] = [[] for _ in range(nodes + 2)]
        self.source, self.sink = nodes, nodes + 1

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.back[a].append(len(self.to[b]))
        self.back[b].append(len(self.to[a]))
        self.to[a].append(b)
        self.to[b].append(a)
        self.room[a].append(forth)
        self.room[b].append(back)

    def _levels(self) -> list[int]:
        level = [-1] * len(self.to)
        level[self.source] = 0
        queue = deque([self.source])
        while queue:
            a = queue.popleft()
            for b, room in zip(self.to[a], self.room[a]):
                if room > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def content_side(self) -> list[bool]:
        """Nodes that stay with the source."""
        while (level := self._levels())[self.sink] >= 0:
            next_edge = [0] * len(self.to)
            path: list[tuple[int, int]] = []
            a = self.source
            while True:
                if a == self.sink:
                    flow = min(self.room[x][k] for x, k in path)
                    for x, k in path:
                        self.room[x][k] -= flow
                        self.room[self.to[x][k]][self.back[x][k]] += flow
                    path, a = [], self.source
                    continue
                while next_edge[a] < len(self.to[a]):
                    k = next_edge[a]
                    b = self.to[a][k]
                    if self.room[a][k] > 1e-9 and level[b] == level[a] + 1:
                        break
                    next_edge[a] += 1
                else:
                    if not path:
                        break
                    a, k = path.pop()
                    next_edge[a] += 1
                    continue
                path.append((a, k))
                a = b
        return [x >= 0 for x in level[: self.source]]


def main_text(page: str | None) -> str:
    """Content blocks of a page, in order, joined by a blank line."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    has_article = any(b.element.article and not (b.element.bad or b.element.furniture) for b in blocks)
    cut = Cut(len(blocks))
    last_under: dict[int, int] = {}
    for k, block in enumerate(blocks):
        score = content_cost(block, has_article)
        cut.edge(cut.source, k, max(score, 0.0))
        cut.edge(k, cut.sink, max(-score, 0.0))
        if k:
            strength = ADJACENT / (1 + tree_distance(blocks[k - 1].element, block.element))
            cut.edge(k - 1, k, strength, strength)
        parent = id(block.element.parent)
        if last_under.get(parent, k - 1) < k - 1:
            cut.edge(last_under[parent], k, SIBLING, SIBLING)
        last_under[parent] = k
    return "\n\n".join(b.text for b, stays in zip(blocks, cut.content_side()) if stays)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column(2)], pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


@query("op8_html_text")
def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
