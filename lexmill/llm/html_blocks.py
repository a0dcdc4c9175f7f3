"""Cutting a page into its leaf blocks: runs of text between block-level tags, with their tag paths.

The reader repairs what pages get wrong: unclosed paragraphs, list items and cells end where the next
begins, stray end tags are ignored, attributes may hold `>`, and a page may end anywhere. Scripts,
styles and comments are not text. Outside quotes a tag holds no `<`, so an unclosed one is text up to the
next, and a page is read in time and memory proportional to its length: a path is the summary that
the labeller needs of it, and the open elements of each tag are known by their places.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from html import unescape
from typing import NamedTuple
from zlib import crc32

_ATTRIBUTES = r"""(?:[^'"<>]++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b{_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>|<[!?][^>]*+(?:>|\Z)""",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!][^>]*\Z")

#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds, up to an element of its scope.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
_PARAGRAPH_SCOPE = frozenset("article aside body button div footer form header html main nav section table td th".split())


#: Numbers that tags and names of a path are hashed to.
TAG_DIMS, NAME_DIMS = 48, 128


class Path(NamedTuple):
    """An element and what is around it: the hashed tags and names of the whole path as bits, and the last element's own."""

    tags: int = 0
    names: int = 0
    tag: str = ""
    own: tuple[str, ...] = ()


class Block(NamedTuple):
    text: str
    path: Path
    linked: int


def hashed(token: str, dims: int) -> int:
    return crc32(token.encode()) % dims


@lru_cache(4096)
def bits_of(tag: str, names: tuple[str, ...]) -> tuple[int, int]:
    words = 0
    for n in names:
        words |= 1 << hashed(n, NAME_DIMS)
    return 1 << hashed(tag, TAG_DIMS), words


class Open:
    """The open elements, with the last place of each tag at hand."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Path, int]] = []  # tag, path, open links
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    @property
    def path(self) -> Path:
        return self.stack[-1][1] if self.stack else Path()

    @property
    def links(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: tuple[str, ...] = ()) -> None:
        path = self.path
        if tag not in INLINE:
            tags, words = bits_of(tag, names)
            path = Path(path.tags | tags, path.names | words, tag, names)
            self.blocks.append(len(self.stack))
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, path, self.links + (tag == "a")))

    def pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def close_implied(self, ends: Iterable[str], scope: Iterable[str]) -> None:
        if (i := self.last(ends)) >= 0 and i > self.last(scope):
            self.pop_to(i)


def names_of(attributes: str) -> tuple[str, ...]:
    found = [x.lower() for m in _NAMES.finditer(attributes) for x in m.groups() if x]
    return tuple(dict.fromkeys(w for x in found for w in _WORD.findall(x)))[:8]


def blocks_of(html: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in page order."""
    out: list[Block] = []
    open_, parts, path = Open(), [], Path()
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, path, min(linked, len(text))))
            parts.clear()
        linked = 0

    html = html or ""
    for m in _TOKEN.finditer(html):
        if (start := m.start()) > at:
            if not parts:
                path = open_.path
            parts.append(html[at:start])
            linked += (start - at) * (open_.links > 0)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            i = open_.last((tag,))
            if tag in INLINE:
                if i > (open_.blocks[-1] if open_.blocks else -1):  # an inline end tag reaches into no other block
                    open_.pop_to(i)
            elif i >= 0:
                flush()
                open_.pop_to(i)
        elif tag in INLINE:
            if tag == "br":
                parts and parts.append(" ")
            elif tag not in VOID:
                open_.push(tag)
        else:
            flush()
            if tag not in VOID:
                if tag in _CLOSES:
                    open_.close_implied(*_CLOSES[tag])
                open_.close_implied(("p",), _PARAGRAPH_SCOPE)
                open_.push(tag, names_of(m[4]) if m[4] else ())
    if at < len(html):
        if not parts:
            path = open_.path
        tail = html[at:]
        cut = _CUT_TAG.search(tail, tail.rfind(">") + 1)
        parts.append(tail[: cut.start()] if cut else tail)
        linked += len(tail) * (open_.links > 0)
    flush()
    return out
