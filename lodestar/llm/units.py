"""Encoding texts by white-space units with a cache in front of any byte-level BPE encoder.

The pre-tokenizer's pattern never matches across the gap before a single space that stands between two
visible characters, nor around a lone line feed, so a text splits there without changing its tokens. Words
repeat, so a worker encodes each unit once. Texts with any other white space are encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

#: White space besides space and line feed.
OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0                　"
ASCII_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f"


class _Units(dict):
    """unit -> encode(prefix + unit). Long units aren't kept; the units of the last half of ``limit`` and those met again since are."""

    def __init__(self, encode: Callable, prefix: str, limit: int):
        self.encode, self.prefix, self.half, self.older = encode, prefix, limit // 2, {}

    def __missing__(self, unit: str):
        found = self.older.pop(unit, None)
        if found is None:
            found = self.encode(self.prefix + unit)
        if len(unit) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found


def irregular(text: str) -> bool:
    return (
        text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE))
    )


class UnitEncoder:
    """``encode(str)`` gives one value for a string; ``parts(text)`` gives the values of a text's units in order."""

    def __init__(self, encode: Callable, limit: int = 240_000):
        self.whole = encode
        self.first = _Units(encode, "", limit // 4)
        self.rest = _Units(encode, " ", limit)

    def parts(self, text: str | None) -> list:
        if not text:
            return []
        if irregular(text):
            return [self.whole(text)]
        out: list = []
        rest, first, feed = self.rest.__getitem__, self.first, None
        for line in text.split("\n"):
            if feed is not None:
                out.append(feed)
            else:
                feed = first["\n"]
            units = line.split(" ")
            out.append(first[units[0]])
            del units[0]
            out.extend(map(rest, units))
        return out
