"""HTML pages as sequences of text blocks.

One scanner goes forward through a page and never back, so its time grows with
the page alone, whatever quotes are stray and whatever tags are never closed.
Open elements are linked nodes that their blocks share; features are carried down
from node to node instead of being gathered from the path of every block.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

# Element names by their part in the layout of a page.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe label legend li "
    "main menu nav noscript object ol optgroup option p pre search section select summary table tbody td "
    "template textarea tfoot th thead title tr ul video".split()
)
#: An opening element ends an open one of these, unless one of the limits lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head", "title"}, set()),
}

#: A tag opens where a letter follows; names and values end as the standard has it.
TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*+")
GAP = re.compile(r"[ \t\n\f\r/]*+")
SPACE = re.compile(r"[ \t\n\f\r]*+")
ATTR_NAME = re.compile(r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+")
BARE_VALUE = re.compile(r"[^ \t\n\f\r>]*+")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.I) for name in ("script", "style")}
NAMING = ("class", "id", "role")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(frozen=True)
class Node:
    """An open element, below its parent. ``names`` are its own tag and names."""

    tag: str
    names: tuple[str, ...]
    parent: "Node | None" = None

    def path(self) -> Iterator[str]:
        """Names from this element up to the root."""
        node = self
        while node is not None:
            yield from node.names
            node = node.parent


@dataclass
class Block:
    """One leaf block: its text, the innermost open element, and the share of its
    characters inside links."""

    text: str
    element: Node | None
    link_share: float

    @property
    def leaf(self) -> str:
        return f"leaf {self.element.tag}" if self.element else "leaf"


class _Scanner:
    """Tags and text of a page in order: (text, None, None, False) or
    (None, name, attributes, whether it ends an element)."""

    def __init__(self, page: str):
        self.page = page
        # The first place from which on a quote does not occur any more.
        self.none_from = {'"': len(page), "'": len(page)}

    def closing(self, quote: str, at: int) -> int:
        if at >= self.none_from[quote]:
            return -1
        end = self.page.find(quote, at)
        if end < 0:
            self.none_from[quote] = at
        return end

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes from ``at`` on and the place after the tag; -1 for a tag that
        the page ends in. A quote is a value's if it opens it, else part of a name.
        A value whose quote never closes ends with the tag."""
        page, found = self.page, []
        while True:
            at = GAP.match(page, at).end()
            if at >= len(page):
                return found, -1
            if page[at] == ">":
                return found, at + 1
            name = ATTR_NAME.match(page, at)
            at = SPACE.match(page, name.end()).end()
            if page[at : at + 1] != "=":
                continue
            at = SPACE.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                end = self.closing(quote, at + 1)
                past = end + 1
                if end < 0:
                    end = past = page.find(">", at)
                    if end < 0:
                        return found, -1
                value, at = page[at + 1 : end], past
            else:
                bare = BARE_VALUE.match(page, at)
                value, at = bare.group(), bare.end()
            found.append((name.group().lower(), value))

    def __iter__(self) -> Iterator[tuple]:
        page, at, text_from = self.page, 0, 0
        while (start := page.find("<", at)) >= 0:
            closes = page.startswith("/", start + 1)
            name = TAG_NAME.match(page, start + 1 + closes)
            follows = page[start + 1 : start + 2]
            if not name and not (follows in ("!", "?") or (closes and start + 2 < len(page))):
                at = start + 1  # a sign in the text
                continue
            yield page[text_from:start], None, None, False
            if name:
                attributes, at = self.attributes(name.end())
                if at < 0:
                    return  # cut inside a tag
                tag = name.group().lower()
                yield None, tag, attributes, closes
                if tag in RAW_END and not closes:
                    end = RAW_END[tag].search(page, at)
                    if not end:
                        return
                    at = end.start()
            elif page.startswith("<!--", start):
                short = page.startswith((">", "->"), start + 4)
                end = COMMENT_END.search(page, start + 4)
                at = page.index(">", start) + 1 if short else end.end() if end else len(page)
            else:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else len(page)
            text_from = at
        yield page[text_from:], None, None, False


class _Reader:
    def __init__(self):
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.links = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len(raw)

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                element = self.stack[-1] if self.stack else None
                self.blocks.append(Block(text, element, min(1.0, self.linked / max(1, len(raw.strip())))))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        self.flush()
        while self.stack and self.stack[-1].tag == "p":
            self._cut(len(self.stack) - 1)
        if tag in ENDS:
            self._end(*ENDS[tag])
        names = [f"tag {tag}"]
        for name, value in attributes:
            if name in NAMING:
                names += (f"is {n.lower()}" for n in NAME.findall(value))
        self.places[tag].append(len(self.stack))
        self.stack.append(Node(tag, tuple(names), self.stack[-1] if self.stack else None))

    def _cut(self, place: int) -> None:
        """Ends the element at ``place`` of the stack and all in it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def _end(self, tags: set[str], limits: set[str]) -> None:
        """Ends all open elements of ``tags`` above the last open one of ``limits``."""
        limit = max((self.places[t][-1] for t in limits if self.places[t]), default=-1)
        inside = [p for t in tags for p in self._above(t, limit)]
        if inside:
            self._cut(min(inside))

    def _above(self, tag: str, limit: int) -> Iterator[int]:
        for place in reversed(self.places[tag]):
            if place < limit:
                break
            yield place

    def close(self, tag: str) -> None:
        self.flush()
        if self.places[tag]:
            self._cut(self.places[tag][-1])


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, without comments, scripts and styles.
    Formulas and drawings are inline: their text stays in the block. A block ends
    where a block element begins or ends; line breaks are white space. Character
    references are decoded, white space is one space. A tag that the page ends in
    is no text."""
    reader = _Reader()
    for text, tag, attributes, closes in _Scanner(page or ""):
        if tag is None:
            reader.text(text)
        elif tag in BLOCKS:
            if closes:
                reader.close(tag)
            else:
                reader.open(tag, attributes)
        elif tag == "a":
            reader.links = 0 if closes else 1
        elif tag in ("br", "hr"):
            reader.text(" ")
            if tag == "hr":
                reader.flush()
    reader.flush()
    return reader.blocks
