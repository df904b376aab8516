"""Main text of web pages by minimum cut.

A page becomes a row of text blocks. A classifier turns each block's features (its text, and the element
or class hint it lies in) into two costs, that of calling it content and that of calling it boilerplate;
they are the capacities to the two terminals of a graph. Text weighs more than the place, so clear text
outweighs its element, and pages without any known element are read by their text. Neighbouring blocks and blocks of one DOM parent are tied by smoothness edges. The maximum flow
cuts content from boilerplate. Blocks whose own costs outweigh all their ties are decided first, which
leaves the cut unchanged and the graph small.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.common import bounded_batches, free_name, texts

TRAINING_PAGES = 2_000  # about so many pages, chosen by a hash, train the content features
NEXT_TIE = 0.6  # smoothness between neighbouring blocks
PARENT_TIE = 0.8  # more between neighbours with one parent
LIMIT = 3.0  # largest log odds of a text feature
PLACE_LIMIT = 2.0  # largest log odds of a place: clear text outweighs it
PLACE_BLOCKS = 20.0  # the expected odds of a place count as so many blocks
TEXT_BLOCKS = 20.0  # what is expected of a text feature counts as so many blocks
# What is expected of text features without any page to learn from, as log odds: by length (a step is a
# factor of about 3.2), share of linked characters (none, some, most), sentence end, and element group
# (paragraph, heading, list item, other).
BY_LENGTH = (-2.0, -1.5, -1.0, -0.3, 1.0, 1.8)
BY_LINKS = (0.3, -0.5, -2.5)
BY_END = (-0.7, 0.7)
BY_GROUP = (0.5, 0.3, -0.3, 0.0)

# The alternatives in order: comment, other declaration, tag with quoted attributes.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_UNCLOSED = re.compile(r"</?[a-zA-Z][^<]*\Z")
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
RAW = frozenset("script style noscript template svg math iframe object textarea select canvas audio video head".split())
FOREIGN = frozenset("svg math".split())  # a trailing slash closes them
NESTED = frozenset("template svg math object select canvas audio video".split())  # the other RAW ones end at the first end tag
SWALLOWING = frozenset("script style textarea template".split())  # without an end tag they take the rest of the page
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset("article main".split())
WRAPPERS = frozenset(["form"])  # boilerplate elements that may hold a whole page
BOILERPLATE = frozenset("nav footer aside form menu dialog button".split())
BAD_HINTS = frozenset(
    "nav navbar menu header footer sidebar side aside ad ads advert advertisement banner promo sponsor sponsored cookie "
    "cookies notice consent comment comments reply share social related breadcrumb breadcrumbs subscribe newsletter "
    "login signup search popup modal widget copyright disclaimer toolbar pagination pager tags".split()
)
GOOD_HINTS = frozenset("article content main post entry story body text".split())
# Where a block lies; the innermost counts. With the share of content that is expected there.
NEITHER, IN_CONTENT, GOOD_HINT, IN_BOILERPLATE, IN_WRAPPER, BAD_HINT = range(6)
PLACES = (0.5, 0.9, 0.8, 0.1, 0.2, 0.2)


@dataclass
class Block:
    text: str
    link_share: float
    place: int
    parent: int
    tag: str


@dataclass
class _Open:
    tag: str
    place: int
    number: int


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    linked: int = 0


def _place(tag: str, attributes: str, outer: int) -> int:
    """Content elements override hints and wrappers around them, good hints only other good ones."""
    good = outer in (NEITHER, IN_CONTENT, GOOD_HINT)
    if tag in BOILERPLATE:
        # A form in a navigation element or the like does not become a wrapper of content.
        return IN_WRAPPER if tag in WRAPPERS and outer != IN_BOILERPLATE else IN_BOILERPLATE
    if tag == "header" and outer not in (IN_CONTENT, GOOD_HINT):
        return IN_BOILERPLATE
    if tag in CONTENT:
        return IN_BOILERPLATE if outer == IN_BOILERPLATE else IN_CONTENT
    if attributes and tag not in ("html", "body"):
        for m in _HINT.finditer(attributes):
            hints = set(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
            if hints & BAD_HINTS:
                return IN_BOILERPLATE if outer == IN_BOILERPLATE else BAD_HINT
            if hints & GOOD_HINTS and good:
                return IN_CONTENT if outer == IN_CONTENT else GOOD_HINT
    return outer


class _Ends:
    """Where RAW elements end: per tag name the ends of its start tags, found in one pass each."""

    def __init__(self, html: str):
        self.html = html
        self.nested: dict[str, dict[int, int]] = {}
        self.none_left: set[str] = set()

    def after(self, tag: str, at: int) -> int | None:
        """Place behind the end tag of the element whose start tag ends at `at`, if it has one."""
        if tag in NESTED:
            if tag not in self.nested:
                self.nested[tag] = self._match(tag)
            return self.nested[tag].get(at)
        if tag in self.none_left:
            return None
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.html, at)
        if not m:
            self.none_left.add(tag)
        return m.end() if m else None

    def _match(self, tag: str) -> dict[int, int]:
        found, starts = {}, []
        pattern = rf"<!--.*?(?:-->|\Z)|<(/?){tag}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
        for m in re.compile(pattern, re.I | re.S).finditer(self.html):
            if m[1] is None or not m[1] and tag in FOREIGN and m[2].rstrip().endswith("/"):
                continue
            if not m[1]:
                starts.append(m.end())
            elif starts:
                found[starts.pop()] = m.end()
        return found


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order, white space collapsed, character references decoded, empty ones left out."""
    page = _Page()
    stack = [_Open("", NEITHER, 0)]
    held: Counter[str] = Counter()  # how many elements of a tag are open
    numbers = 0
    in_link = False
    at = 0
    html = _UNCLOSED.sub("", html) if html.rfind("<") > html.rfind(">") else html

    ends = _Ends(html)

    def add(raw: str) -> None:
        if raw:
            page.words.append(raw)
            if in_link:
                page.linked += len(raw.strip())

    def close_last() -> str:
        tag = stack.pop().tag
        held[tag] -= 1
        return tag

    def close() -> None:
        text = _SPACE.sub(" ", unescape("".join(page.words))).strip()
        if text:
            share = min(1.0, page.linked / max(1, len(text)))
            holder = next((o for o in reversed(stack) if o.tag not in ("p", "li", "td", "th", "dd", "dt")), stack[0])
            page.blocks.append(Block(text, share, stack[-1].place, holder.number, stack[-1].tag))
        page.words, page.linked = [], 0

    while True:
        m = _MARKUP.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            elif tag == "br":
                page.words.append(" ")
            continue
        close()
        if m[1]:
            if held[tag]:  # a stray end tag closes nothing
                while close_last() != tag:
                    pass
            in_link = False
            continue
        if tag in RAW:
            if tag not in FOREIGN or not m[3].rstrip().endswith("/"):
                end = ends.after(tag, at)
                at = end if end is not None else len(html) if tag in SWALLOWING else at
            continue
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        # A paragraph, item or cell ends an open one of its kind within the same container.
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or re.fullmatch("h[1-6]", tag):
            while stack[-1].tag == "p" or stack[-1].tag == tag:
                close_last()
        elif stack[-1].tag == "p":
            close_last()
        numbers += 1
        held[tag] += 1
        stack.append(_Open(tag, _place(tag, m[3], stack[-1].place), numbers))
    close()
    return page.blocks


def features(block: Block) -> int:
    """Content features of a block as one small number: length, link share, sentence end, tag group."""
    length = min(5, int(math.log2(len(block.text) + 1) / 1.7))
    links = 0 if block.link_share < 0.05 else 1 if block.link_share < 0.5 else 2
    ends = int(block.text[-1] in ".!?…:;\"'»”")
    group = 0 if block.tag in ("p", "blockquote", "pre") else 1 if re.fullmatch("h[1-6]", block.tag) else 2 if block.tag == "li" else 3
    return ((length * 3 + links) * 2 + ends) * 4 + group


FEATURES = 6 * 3 * 2 * 4


def expected_text() -> np.ndarray:
    """Log odds of content for every text feature before any page is seen."""
    parts = np.meshgrid(BY_LENGTH, BY_LINKS, BY_END, BY_GROUP, indexing="ij")
    return np.clip(sum(parts).ravel(), -LIMIT, LIMIT)


def learn(counts: np.ndarray) -> np.ndarray:
    """Log odds of content for every text feature, then for every place, from counts (place, feature).

    Places that name content or boilerplate label the blocks for the text features; to these counts comes
    what is expected of a feature, which alone holds where pages have no such places. The odds of a place
    are then those the text features give to its blocks, together with what is expected of it."""
    expected = np.array(PLACES)
    table = np.array([counts[expected < 0.5].sum(axis=0), counts[expected > 0.5].sum(axis=0)])
    share = (table + 0.5) / (table + 0.5).sum(axis=1, keepdims=True)
    content, seen = share[1] / share.sum(axis=0), table.sum(axis=0)
    likely = 1 / (1 + np.exp(-expected_text()))
    text = np.log(seen * content + TEXT_BLOCKS * likely) - np.log(seen * (1 - content) + TEXT_BLOCKS * (1 - likely))
    text = np.clip(text, -LIMIT, LIMIT)
    content = counts @ (1 / (1 + np.exp(-text)))
    odds = np.log(content + PLACE_BLOCKS * expected) - np.log(counts.sum(axis=1) - content + PLACE_BLOCKS * (1 - expected))
    odds[NEITHER] = 0
    return np.concatenate([text, np.clip(odds, -PLACE_LIMIT, PLACE_LIMIT)])


def train(pages: DataFrame, sample: int = TRAINING_PAGES) -> np.ndarray:
    """The log odds of `learn` from a hash sample of about `sample` pages. Blocks outside content and
    boilerplate elements teach nothing."""
    bounded_batches(pages.sparkSession)
    n = pages.count()
    draw = F.pmod(F.xxhash64("html"), F.lit(1 << 30))
    chosen = pages.select("html").where(draw < int(min(1.0, sample / max(1, n)) * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(PLACES), FEATURES), np.int64)
        for b in batches:
            for html in texts(b["html"]):
                for block in blocks_of(html):
                    counts[block.place, features(block)] += 1
        place, f = np.nonzero(counts)
        yield pd.DataFrame({"place": place, "f": f, "n": counts[place, f]})

    counts = np.zeros((len(PLACES), FEATURES))
    rows = chosen.mapInPandas(run, "place int, f int, n long").groupBy("place", "f").agg(F.sum("n").alias("n")).collect()
    for r in rows:
        counts[r["place"], r["f"]] += r["n"]
    return learn(counts)


def label(blocks: list[Block], odds: np.ndarray) -> list[bool]:
    """Content or not, by minimum cut."""
    n = len(blocks)
    costs = [float(odds[features(b)] + odds[FEATURES + b.place]) for b in blocks]
    ties: list[dict[int, float]] = [{} for _ in blocks]

    def tie(a: int, b: int, weight: float) -> None:
        ties[a][b] = ties[a].get(b, 0.0) + weight
        ties[b][a] = ties[b].get(a, 0.0) + weight

    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            tie(i - 1, i, NEXT_TIE)
        if block.parent in last:
            tie(last[block.parent], i, PARENT_TIE)
        last[block.parent] = i
    # Decide every block whose own cost exceeds all its ties, and pass its side on to its neighbours.
    side: list[bool | None] = [None] * n
    free = [sum(t.values()) for t in ties]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(costs[i]) > free[i]:
            side[i] = costs[i] > 0
            for j, weight in ties[i].items():
                if side[j] is None:
                    costs[j] += weight if side[i] else -weight
                    free[j] -= weight
                    queue.append(j)
    # Decided blocks part the others into components, each with a cut of its own.
    for first in range(n):
        if side[first] is not None:
            continue
        number, queue = {first: 0}, deque([first])
        while queue:
            for j in ties[queue.popleft()]:
                if side[j] is None and j not in number:
                    number[j] = len(number)
                    queue.append(j)
        edges = [(k, number[j], w) for i, k in number.items() for j, w in ties[i].items() if j in number and i < j]
        for i, content in zip(number, minimum_cut([costs[i] for i in number], edges), strict=True):
            side[i] = content
    return [bool(s) for s in side]


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut: positive costs tie a node to the source, negative to the sink.
    Shortest augmenting paths; nodes that no source can reach any more are on the sink side."""
    n = len(costs)
    source, sink = n, n + 1
    room: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, c in enumerate(costs):
        a, b = (source, i) if c > 0 else (i, sink)
        room[a][b], room[b][a] = abs(c), 0.0
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return [i in came for i in range(n)]
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        flow = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= flow
            room[b][a] += flow


def main_text(html: str, odds: np.ndarray) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, keep in zip(blocks, label(blocks, odds), strict=True) if keep)


def extract(pages: DataFrame, odds: np.ndarray | None = None) -> DataFrame:
    """`pages` (an `html` column, any others) with a new last column `main_text`.

    Null and empty pages, and pages of boilerplate alone, give an empty text; an empty table gives an empty
    result, repeated pages repeat theirs. Pages are read whole, in time that grows with their length, but
    for the cut of a long run of undecided blocks. Without trained log odds they are learned from `pages`;
    what is expected of texts holds where the pages teach nothing. A clash with a column `main_text` is
    avoided by underscores."""
    bounded_batches(pages.sparkSession)
    learned = train(pages) if odds is None else odds

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, learned) for h in texts(html)], dtype=object)

    return pages.withColumn(free_name(pages, "main_text"), text_of.asNondeterministic()("html"))
