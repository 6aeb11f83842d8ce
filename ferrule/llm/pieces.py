"""Cutting texts at safe places, with per-worker memos of what each cut part becomes."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Entries of a memo's generation.
MEMO_LIMIT = 100_000


#: The pattern of byte-level BPE (a fixed value).
LETTERS_FIRST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: ASCII signs that go on a pre-token of signs but begin no contraction.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space in ASCII but blank and line feed.
_OTHER_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f"


class Memo(dict):
    """A bounded dict that computes missing values. Of two generations the older is dropped when the younger is full, so what is used often
    stays."""

    def __init__(self, make: Callable, limit: int = MEMO_LIMIT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PartMemo:
    """values(text): what the parts of a text become, in order.

    Where a single blank stands between two characters that are not white space, a pre-token of byte-level BPE always ends before the
    blank: a blank begins a pre-token or belongs to a run of white space. So texts are cut there, and what a part becomes is
    remembered. A text with other runs of white space next to blanks is one part.

    `letters`, if given, makes the value (bytes) of one pre-token; a part of letters only is one, and so are the letters before a
    run of signs, and this; a single line feed between other characters is one, too, and what follows it begins anew. Such parts need no pattern.
    """

    def __init__(self, make: Callable[[str], object], limit: int = 2 * MEMO_LIMIT, letters: Callable[[str], bytes] | None = None):
        self.make, self.letters = make, letters
        self.other_space = re.compile(r"[^\S \n]").search
        self.first = Memo(self._bare if letters else make, limit // 8)
        self.rest = Memo(self._letters if letters else lambda part: make(" " + part), limit)
        self.mark = Memo(letters, 1000)

    def _bare(self, part: str) -> bytes:
        return self.letters(part) if part.isalpha() else self.make(part)

    def _letters(self, part: str) -> bytes:
        if part.isalpha():
            return self.letters(" " + part)
        stem = part.rstrip(SIGNS)
        if stem.isalpha():
            return self.rest[stem] + self.mark[part[len(stem) :]]
        if "\n" in part:
            line, _, more = part.partition("\n")
            if line and more and more[0] != "\n":
                return self.rest[line] + self.mark["\n"] + self.first[more]
        return self.make(" " + part)

    def _has_other_space(self, text: str) -> bool:
        return any(x in text for x in _OTHER_SPACE) if text.isascii() else self.other_space(text) is not None

    def values(self, text: str) -> list:
        if not text:
            return []
        if "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or self._has_other_space(text):
            return [self.make(text)]
        head, *tail = text.split(" ")
        return [self.first[head], *map(self.rest.__getitem__, tail)]


class PieceJoiner:
    """A part's value made from its pre-tokens' values (bytes), each remembered."""

    def __init__(self, pattern: str, make: Callable[[str], bytes], limit: int = MEMO_LIMIT):
        self.find, self.piece = regex.compile(pattern).findall, Memo(make, limit)

    def __call__(self, part: str) -> bytes:
        piece = self.piece
        return b"".join([piece[x] for x in self.find(part)])


def part_memo(pattern: str, make: Callable[[str], bytes], limit: int) -> PartMemo:
    """For values of pre-tokens. With another pattern than the usual one all parts go through it, cut at blanks all the same: it must
    let no pre-token go on over a single blank."""
    return PartMemo(PieceJoiner(pattern, make, limit // 4), limit, make if pattern == LETTERS_FIRST else None)
