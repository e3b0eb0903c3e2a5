"""Texts cut into units that a byte-level split pattern never joins, and a memo of what each unit encodes to.

A unit is white space followed by non-space.  Under a split pattern whose pieces take white space only at
their front, a unit splits alone as it does in its text, so equal units have equal ids wherever they stand.
"""

from __future__ import annotations

import re

#: Fixed value: the split pattern known to take white space only at the front of its pieces.  Texts under another are not cut into units.
FRONT_SPACE = frozenset((r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",))

# White space as the pattern's \s has it; Python's also counts U+001C..U+001F.
_UNITS = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
_RUNS = re.compile(r"\s\s")
# Pairs of spaces and newlines, and all other white space: a text with none of these has no run.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_ODD_ASCII = (*_PAIRS, *(c for c in _ODD if c < "\x80"))
_ODD_ALL = (*_PAIRS, *_ODD)


def _spaced(text: str) -> bool:
    """Whether the text has two characters of white space in a row.  Most texts have none, and single characters are found faster than the pattern."""
    for odd in _ODD_ASCII if text.isascii() else _ODD_ALL:
        if odd in text:
            return _RUNS.search(text) is not None
    return False


def unit_keys(text: str) -> list[str]:
    """Keys of the text's units in order.  ``literal`` gives a key's unit; equal units need not have equal keys."""
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or _spaced(text):
        return [" " + u for u in _UNITS.findall(text)]
    keys = text.replace("\n", " \n").split(" ")
    keys[0] = " " + keys[0]
    return keys


def literal(key: str) -> str:
    """The unit that a key stands for: a leading space marks a unit as it is, a newline is its own mark."""
    first = key[:1]
    return key[1:] if first == " " else key if first == "\n" else " " + key


class Memo(dict):
    """At most ``limit`` entries.  When full it takes no more, and starts anew after as many misses as it holds."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.missed = limit, 0

    def keep(self, key, value) -> None:
        if len(self) < self.limit:
            self[key] = value
            return
        self.missed += 1
        if self.missed > 4 * self.limit:
            self.clear()
            self.missed = 0

    def keep_all(self, entries: dict) -> None:
        if len(self) + len(entries) <= self.limit:
            self.update(entries)
            return
        for key, value in entries.items():
            self.keep(key, value)
