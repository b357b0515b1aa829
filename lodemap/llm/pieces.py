"""Cutting texts into pre-tokens by a pattern, with the letters and numbers that the tokenizer libraries know."""

from __future__ import annotations

import functools
import re
from itertools import chain

import regex
import tiktoken

#: A letter, a number and a mark, none of them ASCII, that stand for others of their class.
LETTER, NUMBER, MARK = "ª", "²", "¦"


@functools.lru_cache(maxsize=1)
def disputed() -> dict[int, str]:
    """The code points that the regex module classes otherwise than the libraries, with what stands for them.

    The modules' Unicode tables differ. A library is asked by cutting a text of all code points by one class: what lies between
    the matches is not encoded, so what comes back is the class.
    """
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    ours, theirs = [], []
    for kind in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        ours.append(set(regex.findall(kind, every)))
        theirs.append(set(probe.decode(probe.encode_ordinary(every))))
    out = {}
    for c in (ours[0] ^ theirs[0]) | (ours[1] ^ theirs[1]):
        out[ord(c)] = LETTER if c in theirs[0] else NUMBER if c in theirs[1] else MARK
    return out


class Cutter:
    """The matches of a pattern in a text. Disputed characters are replaced for the search, one for one, so places stay."""

    def __init__(self, pattern: str, table: dict[int, str] | None = None):
        self.pattern = regex.compile(pattern)
        self.table = disputed() if table is None else table
        points = sorted(self.table)
        starts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
        ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
        ranges = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))
        self.odd = re.compile(f"[{ranges}]" if ranges else r"(?!)")

    def __reduce__(self):
        return Cutter, (self.pattern.pattern, self.table)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.odd.search(text):
            return self.pattern.findall(text)
        plain = text.translate(self.table)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
