"""Quality rules as a short-circuit cascade, ordered by rejection per cost as a sample of the table shows them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mapped, sampled, utf8


SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_ENDS = (b".", b"!", b"?", b'"', b"'", b":", b";", b")", "…".encode(), "»".encode(), "”".encode())


class TextStats:
    """Statistics of one text, each computed when a rule or the caller first asks for it."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that begin one, without white space."""
        points = len(self.text) if self.text.isascii() else len(self.text.decode())
        return points - sum(map(self.text.count, (_SPACE[i : i + 1] for i in range(len(_SPACE)))))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside any three-word window that the text has twice or more."""
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        codes = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, n)
        _, pairs = np.unique(codes[:-1] * len(number) + codes[1:], return_inverse=True)
        _, at, times = np.unique(pairs[:-1] * len(number) + codes[2:], return_inverse=True, return_counts=True)
        twice = times[at] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        return int(hit.sum())

    @cached_property
    def n_upper_words(self) -> int:
        """Words with a letter and without a lower-case one."""
        return sum(map(str.isupper, map(bytes.decode, self.words)))

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_ended_lines(self) -> int:
        return sum(x.rstrip().endswith(_ENDS) for x in self.lines)


@dataclass(frozen=True)
class Rule:
    """Rejects a text when ``rejects`` says so of its statistics."""

    name: str
    rejects: Callable[[TextStats], bool]


#: The production rules. Each stands alone: a text is kept if no rule rejects it, in whatever order they run.
RULES = (
    Rule("few_words", lambda s: s.n_words < 50),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("word_length", lambda s: s.word_chars < 2 * s.n_words or s.word_chars > 15 * s.n_words),
    Rule("repeated_lines", lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("shouting", lambda s: 2 * s.n_upper_words > s.n_words),
)

#: The rules whose failure the result calls ``base_failed``.
BASE = ("few_words", "repeated_windows")

EMITTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rejected_by(text: bytes | TextStats, rules: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects a text; those behind it are not run."""
    stats = text if isinstance(text, TextStats) else TextStats(text)
    return next((r.name for r in rules if r.rejects(stats)), None)


def plan(sample: list[bytes], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejection per second, largest first; each is timed alone, on statistics of its own.

    A rule that rejects nothing in the sample goes behind those that do, the cheapest first. Without a sample the order stays.
    """
    if not sample:
        return rules
    found = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(TextStats(x)) for x in sample)
        seconds = max(time.perf_counter() - began, 1e-9)
        found.append((-(rejected / len(sample)) / seconds, seconds, rule.name, rule))
    return tuple(x[-1] for x in sorted(found, key=lambda x: x[:3]))


def apply_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", sample: list[bytes] | None = None
) -> DataFrame:
    """Key, the statistics ``EMITTED`` of every whole text, base_failed and kept.

    The rules run as a cascade in the order that ``plan`` finds on a bounded sample, and stop at the first rejection (the
    order never changes a verdict);
    statistics that a rule has computed are the ones returned. Words are runs without ASCII white space. Null and empty
    texts have no words and fail. Repeated rows are judged each for itself, other columns are ignored, and an empty table
    gives no rows.
    """
    order = plan(sampled(docs, key, text) if sample is None else sample, rules)
    base = tuple(r for r in rules if r.name in BASE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            columns: list[list] = [[] for _ in range(len(EMITTED) + 2)]
            for body in utf8(block, "__text"):
                stats = TextStats(body)
                why = rejected_by(stats, order)
                for column, name in zip(columns, EMITTED, strict=False):
                    column.append(getattr(stats, name))
                columns[-2].append(rejected_by(stats, base) is not None)
                columns[-1].append(why is None)
            kinds = [pa.int64()] * len(EMITTED) + [pa.bool_()] * 2
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), *arrays], names=["__key", *EMITTED, "base_failed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = f"__key {kind}, " + ", ".join(f"{n} long" for n in EMITTED) + ", base_failed boolean, kept boolean"
    return mapped(rows, run, schema).withColumnRenamed("__key", key)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns, whatever their names; here a text costs no more than the rules up
    to its rejection. Null and empty texts go (``few_words``); repeated rows fare alike; an empty table gives no rows."""
    order = plan(sampled(docs, key, text), rules)
    kinds = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.filter(pa.array([rejected_by(x, order) is None for x in utf8(block, text)], pa.bool_()))

    return mapped(docs, run, kinds)
