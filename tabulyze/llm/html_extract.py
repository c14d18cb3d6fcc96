"""Main text of web pages by minimum-cut labelling of text blocks.

Every page becomes a small graph: blocks of one parent element form a node, a linear
classifier of markup and text gives the capacities to the two terminals, neighbours in page
order and in the element tree are joined by smoothness edges, and the minimum cut separates
content from the rest. One row in, one row out; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements by what they do to the text, and name parts that mark their role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template title textarea select option button svg math iframe object head datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
OUTSIDE = frozenset("nav header footer aside menu dialog".split())
INSIDE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
                      "breadcrumb breadcrumbs sidebar side widget footer header masthead toolbar pagination pager cookie cookies consent gdpr "
                      "notice alert popup modal overlay newsletter subscribe signup login share sharing social related recommended tags "
                      "comment comments commentlist reply replies respond disqus discussion skip search copyright legal disclaimer hidden".split())
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())   # prose of others
GOOD_NAMES = frozenset("article content main post story entry body text".split())
COMMENT_TITLES = re.compile(r"^(\d+ )?(comments?|responses|kommentare?|commentaires?|comentarios?)( \(?\d+\)?)?:?$", re.I)
SENTENCE_END = re.compile(r"[.!?…][\"'”»)]*(\s|$)")
NAME_PART = re.compile(r"[a-z]+")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
TAG_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,63})")   # no longer name is known
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
UNIT = 100          # capacities are whole hundredths
STRONG = 40 * UNIT  # beyond any sum of smoothness edges of one block


@dataclass
class Element:
    tag: str
    number: int
    depth: int
    parent: "Element | None"
    outside: bool
    inside: bool = False
    named: bool = False    # a form, or a name that speaks against it
    good: bool = False     # a name that speaks for it
    readers: bool = False  # a name of reader comments, where prose tells nothing
    within: bool = False   # in article or main markup
    weight: float = 0.0    # odds taken from its text for such names
    titled: bool = False   # a heading of reader comments came before


@dataclass
class Block:
    text: str
    linked: int
    element: Element


@dataclass
class Node:
    blocks: list[Block] = field(default_factory=list)
    gain: int = 0          # capacity from the content terminal
    loss: int = 0          # capacity to the other terminal


def _names(attributes: str) -> tuple[set[str], bool]:
    """Parts of class, id and role, and whether the element is hidden or, by a whole name, of readers."""
    parts, hidden = set(), False
    for match in ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
        if name in ("class", "id", "role"):
            parts.update(NAME_PART.findall(value))
            hidden = hidden or not READERS.isdisjoint(value.split())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return parts, hidden


def tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and of ``>``, and for each where a tag ends that reaches it outside of
    quotes, -1 where a quote is never closed. From the last to the first, each is looked at once."""
    places = [m.start() for m in SPECIAL.finditer(page)]
    ends, later = [-1] * len(places), {}
    for k in range(len(places) - 1, -1, -1):
        c = page[places[k]]
        if c == ">":
            ends[k] = places[k]
        else:
            close = later.get(c)
            if close is not None and close + 1 < len(places):
                ends[k] = ends[close + 1]
            later[c] = k
    return places, ends


class Tokens:
    """(text, tag, closing, attributes) of a page from front to back in linear time.

    Most pages need one pattern. Where a tag does not end for it, because a quote or the tag
    itself is left open, the ends of all tags are worked out once; such a tag ends at the next
    ``>``, and is text where there is none.
    """

    def __init__(self, page: str):
        self.page, self.place, self.ends = page, 0, None
        self.last = page.rfind(">")
        self.unclosed: set[str] = set()

    def next(self) -> tuple[str, str, bool, str]:
        match = TOKEN.match(self.page, self.place) if self.ends is None else None
        if match is None or match[0] == "<":
            head = TAG_HEAD.match(self.page, self.place)
            if head:
                return self._broken(head)
            match = match or TOKEN.match(self.page, self.place)
        self.place = match.end()
        if match[2]:
            return "", match[2].lower(), bool(match[1]), match[3]
        return match[0], "", False, ""

    def _broken(self, head: re.Match) -> tuple[str, str, bool, str]:
        if self.ends is None:
            self.ends = tag_ends(self.page)
        places, ends = self.ends
        k = bisect_left(places, head.end())
        end = ends[k] if k < len(places) else -1
        if end < 0:
            end = self.page.find(">", head.end()) if head.end() <= self.last else -1
        if end < 0:
            self.place += 1
            return "<", "", False, ""
        self.place = end + 1
        return "", head[2].lower(), bool(head[1]), self.page[head.end():end]

    def skip(self, tag: str) -> None:
        """Go on behind the end of an element whose content is no text, if it has one."""
        if tag not in self.unclosed:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(self.page, self.place)
            if tag == "head":
                # an unclosed head ends where the body begins
                end = end or re.compile(r"(?=<body\b)", re.I).search(self.page, self.place)
            if end:
                self.place = end.end()
                return
            self.unclosed.add(tag)      # there is none further on either
        if tag in RAW:
            self.place = len(self.page)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order. Open elements close with their parents, and a paragraph or
    list item also at the next one, as browsers do. The time grows with the page's length only,
    however broken its markup."""
    root = Element("", 0, 0, None, False)
    elements = [root]
    top, count = root, 0
    open_: Counter[str] = Counter()
    found: list[Block] = []
    parts: list[str] = []
    linked, links = 0, 0
    tokens, size = Tokens(page), len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, linked, top))
            if top.tag in HEADINGS and top.parent is not None and COMMENT_TITLES.match(text):
                top.parent.titled = True
        parts.clear()
        linked = 0

    while tokens.place < size:
        text, tag, closing, attributes = tokens.next()
        if not tag:
            if text[0] != "<" or text == "<":
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        if not closing and tag in SKIPPED:
            if not attributes.endswith("/"):
                tokens.skip(tag)
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            links = 0
            if open_[tag]:
                while top.tag != tag:
                    open_[top.tag] -= 1
                    top = top.parent
                open_[tag] -= 1
                top = top.parent
            continue
        if top.tag == "p" or tag == top.tag and tag in ("li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
            open_[top.tag] -= 1
            top = top.parent
        names, hidden = _names(attributes) if attributes else ((), False)
        out, page_wide = hidden or tag in OUTSIDE, tag in ("html", "body")
        named = tag == "form" or not BAD_NAMES.isdisjoint(names)
        count += 1
        element = Element(tag, count, top.depth + 1, top, top.outside or out and not page_wide)
        element.outside |= top.titled
        element.named = named and not page_wide
        element.good = not out and not (named and page_wide) and not GOOD_NAMES.isdisjoint(names)
        element.readers = tag not in INSIDE and not READERS.isdisjoint(names)
        elements.append(element)
        if tag not in VOID:
            top = element
            open_[tag] += 1
    flush()
    _weigh(elements, found)
    return found


def _weigh(elements: list[Element], blocks: list[Block]) -> None:
    """What forms and names take from the odds of the text in them.

    Nothing, where the element holds most of the page's unlinked text, also of that in article
    or main markup if there is any. Otherwise as much as
    keeps any block out, less a share for long sentences without links, which counts twice
    in article or main markup; only there can a block outweigh it.
    """
    plain, marked, prose, long_ = ([0] * len(elements) for _ in range(4))
    for e in elements[1:]:
        e.within = e.parent.within or e.tag in INSIDE
    for block in blocks:
        e, n = block.element, max(0, len(block.text) - block.linked)
        if e.outside or e.parent is not None and e.parent.titled:
            continue
        plain[e.number] += n
        marked[e.number] += n if e.within else 0
        if not block.linked and SENTENCE_END.search(block.text):
            prose[e.number] += n if n >= 80 else 0
            long_[e.number] += n if n >= 200 else 0
    for e in reversed(elements[1:]):       # children follow their parents
        for sums in (plain, marked, prose, long_):
            sums[e.parent.number] += sums[e.number]
    for e in elements[1:]:
        markup, own, k = e.tag in INSIDE, 0.0, e.number
        most = 2 * plain[k] > plain[0] and 2 * marked[k] >= marked[0]
        if e.named and not most:
            share = 0.0 if e.readers or not plain[k] else (prose if markup else long_)[k] / plain[k]
            own = 12.0 - (9.0 if e.within else 4.5) * share
        e.weight = min(12.0, e.parent.weight + own)
        e.inside = e.parent.inside or markup or e.good and not own


def _score(block: Block) -> float:
    """Log odds of content, from markup and text. The weights are set, not learned: pages
    carry no labels."""
    e, text = block.element, block.text
    odds = -0.6 + (3.0 if e.inside else 0.0) - (12.0 if e.outside or e.parent is not None and e.parent.titled else e.weight)
    odds += min(2.5, len(text) / 80)
    odds += 1.2 if SENTENCE_END.search(text) else -0.8
    odds -= 4.0 * min(1.0, block.linked / len(text))
    if e.tag in ("p", "blockquote", "pre", "td", "dd") or e.tag in HEADINGS:
        odds += 0.8
    elif e.tag in ("li", "th", "dt"):
        odds -= 0.4
    return odds


def _joined(a: Block, b: Block) -> bool:
    """Blocks that get one label: both outside or both not, children of one parent."""
    x, y = a.element, b.element
    return x.outside == y.outside and x.inside == y.inside and x.weight == y.weight and (x is y or x.parent is y.parent and x.parent is not None and x.tag[:1] == y.tag[:1])


def graph_of(blocks: list[Block]) -> tuple[list[Node], list[tuple[int, int, int]]]:
    """Nodes in page order and undirected edges (a, b, capacity)."""
    nodes: list[Node] = []
    for block in blocks:
        if not nodes or not _joined(nodes[-1].blocks[-1], block):
            nodes.append(Node())
        node, odds = nodes[-1], _score(block)
        node.blocks.append(block)
        if odds >= 0:
            node.gain += int(odds * UNIT)
        else:
            node.loss += int(-odds * UNIT)
    edges = []
    for k in range(1, len(nodes)):
        edges.append((k - 1, k, UNIT))
        # also those a little further on in page order, if they are near in the tree
        for back in (1, 2, 3):
            if k >= back and (d := _distance(nodes[k - back].blocks[-1].element, nodes[k].blocks[0].element)) <= 4:
                edges.append((k - back, k, 2 * UNIT // (1 + d)))
    return nodes, edges


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(gain: list[int], loss: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the content side, by augmenting along shortest paths in levels."""
    n = len(gain)
    source, sink = n, n + 1
    ends: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(ends))
        ends.append(b)
        room.append(there)
        out[b].append(len(ends))
        ends.append(a)
        room.append(back)
    for k in range(n):
        both = min(gain[k], loss[k])     # flow straight through
        if gain[k] > both:
            join(source, k, gain[k] - both, 0)
        if loss[k] > both:
            join(k, sink, loss[k] - both, 0)
    for a, b, c in edges:
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, a = [], source
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if room[e] and level[ends[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                a = ends[path.pop() ^ 1]
                continue
            path.append(e)
            a = ends[e]


def extract(page: str) -> str:
    """The main text, blocks joined by blank lines."""
    nodes, edges = graph_of(blocks_of(page))
    if not nodes:
        return ""
    kept = minimum_cut([x.gain for x in nodes], [x.loss for x in nodes], edges)
    return "\n\n".join(b.text for x, good in zip(nodes, kept, strict=True) if good for b in x.blocks)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) for every row.

    Null and empty pages, and pages without content, give the empty text; broken markup is
    read as far as it goes; repeated rows give the same text again; an empty table gives no
    rows; other columns are not read.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(v.as_py() or "") for v in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
