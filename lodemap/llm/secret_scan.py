"""Secret scans: Boolean trigram queries from the rules' patterns, an inverted index of trigrams a block of texts at a time."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mapped, utf8

#: Strings that one part of a pattern may stand for before its query gives up on that part.
MOST_STRINGS = 64

# --- Boolean queries ---------------------------------------------------------------------------------------------------

#: A query is True (matches any text), a trigram, or ("and" | "or", frozenset of queries).
Query = bool | bytes | tuple[str, frozenset]


def _join(kind: str, parts: list[Query]) -> Query:
    """Flattens, drops what is implied and absorbs: True is neutral in an "and" and swallows an "or"."""
    found: set = set()
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        found |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if not found:
        return True
    return next(iter(found)) if len(found) == 1 else (kind, frozenset(found))


def _trigrams(text: bytes) -> Query:
    return _join("and", [text[i : i + 3] for i in range(len(text) - 2)])


@dataclass(frozen=True)
class _Part:
    """What is known of the texts that a part of a pattern matches: all of them (exact), or else their possible beginnings and
    ends; and a query that any text with a match fulfils."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes]
    suffix: frozenset[bytes]
    query: Query = True


_ANY = _Part(None, frozenset([b""]), frozenset([b""]))
_EMPTY = _Part(frozenset([b""]), frozenset([b""]), frozenset([b""]))


def _of_strings(strings: frozenset[bytes]) -> Query:
    return _join("or", [_trigrams(x) for x in strings])


def _short(strings: frozenset[bytes], cut) -> frozenset[bytes]:
    out = frozenset(map(cut, strings))
    return out if len(out) <= MOST_STRINGS else frozenset([b""])


def _open(part: _Part) -> _Part:
    """A part whose exact strings, where it has any, become query, beginnings and ends."""
    if part.exact is None:
        return part
    return _Part(
        None,
        _short(part.exact, lambda x: x[:2]),
        _short(part.exact, lambda x: x[-2:]),
        _join("and", [part.query, _of_strings(part.exact)]),
    )


def _concat(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        both = frozenset(x + y for x in a.exact for y in b.exact)
        return _Part(both, both, both, _join("and", [a.query, b.query]))
    ends = a.exact if a.exact is not None else a.suffix
    starts = b.exact if b.exact is not None else b.prefix
    across: Query = True
    if len(ends) * len(starts) <= MOST_STRINGS * MOST_STRINGS:
        across = _of_strings(frozenset(x + y for x in ends for y in starts))
    prefix, suffix = _open(a).prefix, _open(b).suffix
    if a.exact is not None and len(a.exact) * len(starts) <= MOST_STRINGS:
        prefix = _short(frozenset(x + y for x in a.exact for y in starts), lambda x: x[:2])
    if b.exact is not None and len(b.exact) * len(ends) <= MOST_STRINGS:
        suffix = _short(frozenset(x + y for x in ends for y in b.exact), lambda x: x[-2:])
    return _Part(None, prefix, suffix, _join("and", [_open(a).query, _open(b).query, across]))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        every = frozenset().union(*(p.exact for p in parts))
        if len(every) <= MOST_STRINGS and all(p.query is True for p in parts):
            return _Part(every, every, every)
    opened = [_open(p) for p in parts]
    return _Part(
        None,
        _short(frozenset().union(*(p.prefix for p in opened)), bytes),
        _short(frozenset().union(*(p.suffix for p in opened)), bytes),
        _join("or", [p.query for p in opened]),
    )


def _set(items: list) -> _Part:
    chars: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            chars.add(chr(value))
        elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            chars |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return _ANY
    return _strings(chars)


def _strings(chars: set[str]) -> _Part:
    folded = frozenset(c.lower().encode() for c in chars)
    return _Part(folded, folded, folded) if len(folded) <= MOST_STRINGS // 2 else _ANY


def _walk(tree) -> _Part:
    out = _EMPTY
    for kind, value in tree:
        if kind is sre.LITERAL:
            part = _strings({chr(value)})
        elif kind is sre.IN:
            part = _set(value)
        elif kind is sre.BRANCH:
            part = _either([_walk(x) for x in value[1]])
        elif kind is sre.SUBPATTERN:
            part = _walk(value[-1])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            once = _walk(inner)
            if least == 0:
                part = _either([_EMPTY, once]) if most == 1 and once.exact is not None else _ANY
            elif least == most == 1:
                part = once
            else:
                part = once
                for _ in range(min(int(least), 8) - 1):
                    part = _concat(part, once)
                part = _open(part) if least == most and least <= 8 else _repeated(part, once)
        elif kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _EMPTY
        else:  # any character, categories, references: nothing is certain
            part = _ANY
        out = _concat(out, part)
    return out


def _repeated(part: _Part, once: _Part) -> _Part:
    """At least ``part``, then more: its beginnings hold, its ends are those of one more turn or its own."""
    opened, turn = _open(part), _open(once)
    keep = all(len(x) >= 2 for x in turn.suffix)
    return _Part(None, opened.prefix if all(len(x) >= 2 for x in opened.prefix) else frozenset([b""]), turn.suffix if keep else frozenset([b""]), opened.query)


def trigram_query(pattern: str) -> Query:
    """The Boolean query that every text with a match of ``pattern`` fulfils, over trigrams of its lower-cased bytes."""
    return _open(_walk(sre_parser.parse(pattern))).query


def query_trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(query_trigrams, query[1]))


# --- rules -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: leftmost non-overlapping matches of ``pattern``, kept when ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    query: Query = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern))

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


def either_case(words: str) -> str:
    """A pattern's letters, each as a set of both cases."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: The three base kinds, then those that the method adds.
RULES = (
    SecretRule(
        "assign",
        "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
        base=True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    SecretRule("hex", r"[0-9a-f]{32,}", least=32, base=True),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+-]{4,64}@"),
)

# --- index -------------------------------------------------------------------------------------------------------------


class TrigramIndex:
    """Postings, over a block of texts, of the trigrams that any of some queries names."""

    def __init__(self, texts: list[bytes], wanted: set[bytes]):
        self.size = len(texts)
        number = {t[0] << 16 | t[1] << 8 | t[2]: t for t in wanted}
        flag = np.zeros(1 << 24, bool)
        flag[list(number)] = True
        # two separators keep trigrams from crossing texts
        joined = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]]) if texts else np.zeros(0, np.int64)
        self.postings: dict[bytes, np.ndarray] = {}
        if len(joined) < 3 or not number:
            return
        first_two = np.zeros(1 << 16, bool)
        first_two[[k >> 8 for k in number]] = True
        pairs = joined[:-2].astype(np.uint16) << 8 | joined[1:-1]
        near = np.flatnonzero(first_two[pairs])
        codes = pairs[near].astype(np.uint32) << 8 | joined[near + 2]
        hit = flag[codes]
        near, codes = near[hit], codes[hit]
        owner = np.searchsorted(starts, near, "right") - 1
        both = np.unique(codes.astype(np.int64) * self.size + owner)
        for code, docs in zip(*_grouped(both // self.size, both % self.size), strict=True):
            self.postings[number[code]] = docs

    def candidates(self, query: Query) -> np.ndarray:
        """The texts that fulfil a query, by intersecting and uniting postings; all of them for True."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings.get(query, np.zeros(0, np.int64))
        kind, parts = query
        found = sorted((self.candidates(p) for p in parts), key=len)
        out = found[0]
        for f in found[1:]:
            out = np.intersect1d(out, f, assume_unique=True) if kind == "and" else np.union1d(out, f)
        return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    at = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], at])].tolist(), np.split(values, at)


def find_secrets(texts: list[bytes], rules: tuple[SecretRule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, end, number of the rule) in code points, by start and then rule."""
    wanted = set().union(*(query_trigrams(r.query) for r in rules))
    index = TrigramIndex(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for k, rule in enumerate(rules):
        for i in index.candidates(rule.query).tolist():
            if i not in decoded:
                decoded[i] = texts[i].decode()
            found[i].extend((a, b, k) for a, b in rule.spans(decoded[i]))
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in found]


SPAN = "struct<kind:string,start:long,end:long,base:boolean>"


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``spans``, an array of (kind, start, end, base) over every whole text, in code points with the end exclusive.

    Each block of texts gets an inverted index of the trigrams in the rules' queries; a rule looks only at the texts that
    fulfil its query, and at all of them where its pattern has no mandatory trigram. Null and empty texts have no spans;
    repeated rows are scanned each for itself; other columns are ignored; an empty table gives no rows. Spans are ordered by
    start, then by the order of the rules; spans of different kinds may overlap.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            spans = [
                [{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, b, k in found]
                for found in find_secrets(utf8(block, "__text"), rules)
            ]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(spans, pa.list_(one))], names=["__key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return mapped(rows, run, f"__key {kind}, spans array<{SPAN}>").withColumnRenamed("__key", key)
