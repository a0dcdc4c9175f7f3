"""Pre-tokenisation and piece lookup for the word-end BPE vocabulary, equal to the library's result.

Text is cut at special strings and white space, neither of which anything reaches across: composition
and case don't, and pre-tokens hold no white space. Words of Latin letters and common marks are normalised and cut by
a compiled pattern; a word with any other character is normalised and cut by the library's own
normaliser and pre-tokeniser, once per distinct word. The library's model then makes the pieces of each
distinct pre-token. No text is tokenised whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array

VOCABULARY = "word_bpe_49k.json"
#: Up to here (Latin letters, no combining marks) composition and case are per character.
_LAST = 0x17F
_EXTRA = "‐-‧‰-⁞€"


def _of(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(_LAST + 1) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _of("L"), _of("N")
_ODD = re.compile(f"[^\\x00-\\u017f{_EXTRA}]|[İ\x1c-\x1f\x85]")
_CONTROLS = b"\x1c\x1d\x1e\x1f\x85"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_SPACES = re.compile("[ \t-\r]+")
#: Odd words that a worker knows the cut of; longer ones are cut each time.
_MOST, _LONGEST = 100_000, 64


def tokenizer(path: str | None = None):
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Tokenizer.from_file(path)


class Cutter:
    """Cuts texts into pre-tokens; a special string is one by itself."""

    def __init__(self, path: str | None = None):
        from tokenizers import pre_tokenizers

        tool = tokenizer(path)
        self.normal, self.cut, self.model = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str, tool.model.tokenize
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.special = {t.content: i for i, t in tool.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, list[str]] = {}

    def odd_word(self, word: str) -> list[str]:
        found = self.known.get(word)
        if found is None:
            normal = self.normal(word)
            found = [normal[a:b] for _, (a, b) in self.cut(normal)]
            if len(word) <= _LONGEST:
                if len(self.known) >= _MOST:
                    self.known.clear()
                self.known[word] = found
        return found

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:  # quick for Latin-1; anything else goes through the pattern
            plain = text.encode("latin-1")
            odd = len(plain.translate(None, _CONTROLS)) != len(plain)
        except UnicodeEncodeError:
            odd = _ODD.search(text) is not None
        if "<|" in text and self.at_special and len(parts := self.at_special.split(text)) > 1:
            return [w for k, part in enumerate(parts) for w in ((part,) if k % 2 else self.words(part))]
        if not odd:
            return _PIECE.findall(text.lower())
        out: list[str] = []
        run: list[str] = []
        for word in _SPACES.split(text):
            if _ODD.search(word):
                out += _PIECE.findall(" ".join(run).lower())
                out += self.odd_word(word)
                run.clear()
            else:
                run.append(word)
        return out + _PIECE.findall(" ".join(run).lower())

    def ids(self, word: str) -> list[int]:
        """The ids of a pre-token."""
        if (i := self.special.get(word)) is not None:
            return [i]
        return [t.id for run, _ in self.as_bytes(word) for t in self.model(run)]


_cutters: dict = {}


def cutter(path: str | None = None) -> Cutter:
    """This worker's cutter; it outlives a task, so later tasks find most odd words known."""
    if path not in _cutters:
        _cutters.clear()
        _cutters[path] = Cutter(path)
    return _cutters[path]


class Pieces(dict):
    """Pre-token to its ids as little-endian 32-bit bytes; filled on demand, emptied when full."""

    def __init__(self, path: str | None = None, most: int = 300_000):
        self.cutter, self.most = cutter(path), most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = array("I", self.cutter.ids(word))
        if sys.byteorder == "big":
            ids.byteswap()
        self[word] = found = ids.tobytes()
        return found

    def ids(self, text: str | None) -> bytes:
        """All ids of a text."""
        return b"".join(map(self.__getitem__, self.cutter.words(text or "")))
