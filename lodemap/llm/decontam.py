"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, one pass over each text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, code_points, mapped, utf8, written

#: Consecutive item words that make a window.
WINDOW = 10
#: UTF-8 bytes of item text behind one automaton. Items beyond it go to further automata, each over all documents.
AUTOMATON_BYTES = 8_000_000

#: A-Z to lower case, every other ASCII character that is no letter or digit to a space; bytes of non-ASCII stay.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def item_windows(text: bytes, window: int = WINDOW) -> list[bytes]:
    """The windows of one item; an item of fewer words, but not none, is one window."""
    words = text.translate(FOLD).split()
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Scanner:
    """An automaton over all windows of some items. Texts are held as one character a byte, which keeps lengths equal."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).add(item)
        self.machine = ahocorasick.Automaton()
        for w, who in owners.items():
            self.machine.add_word(" " + w.decode("latin-1") + " ", (len(w), w.count(b" ") + 1, sorted(who)))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def scan(self, text: bytes) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        """Words, words hit, items that occur, and the hit stretches as code point spans of the original text."""
        words = text.translate(FOLD).split()
        if self.empty or not words:
            return len(words), 0, [], []
        plain = " " + b" ".join(words).decode("latin-1") + " "
        items: set[str] = set()
        runs: list[list[int]] = []
        word = seen = 0  # the word that begins after the space at `seen`
        for end, (size, n, who) in self.machine.iter(plain):
            items.update(who)
            start = end - size - 1
            word += plain.count(" ", seen, start) if start >= seen else -plain.count(" ", start, seen)
            seen = start
            runs.append([word, word + n])
        merged: list[list[int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return len(words), sum(b - a for a, b in merged), sorted(items), _spans(text, merged)


def _spans(text: bytes, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Code point spans, in the original text, of runs of words given by their numbers."""
    if not runs:
        return []
    folded, bounds, at = text.translate(FOLD), [], 0
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    points = iter(code_points(text, (x for a, b in runs for x in (bounds[a][0], bounds[b - 1][1]))))  # runs are in order, and apart
    return list(zip(points, points, strict=True))


#: The scanner that a worker holds, and of which broadcast; one at a time.
_held: tuple[int | None, Scanner | None] = (None, None)


def _scanner(shared: Broadcast, window: int) -> Scanner:
    global _held
    if _held[0] != (shared.value[0], window):
        _held = (None, None)
        _held = ((shared.value[0], window), Scanner([(item, text.encode()) for item, text in shared.value[1]], window))
    return _held[1]


def _shared(docs: DataFrame, items: list[tuple[str, str]]) -> Broadcast:
    """A block of items, which ``item_blocks`` bounds, under a name of its own."""
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def _scanned(docs: DataFrame, items: list[tuple[str, str]], key: str, text: str, window: int) -> DataFrame:
    shared = _shared(docs, items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(shared, window)
        for block in blocks(batches, "__text"):
            found = [scanner.scan(x) for x in utf8(block, "__text")]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.list_(pa.string())),
                    pa.array(
                        [[{"start": a, "end": b} for a, b in f[3]] for f in found],
                        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                    ),
                ],
                names=["__key", "n_words", "n_hit", "items", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return mapped(rows, scan, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = AUTOMATON_BYTES) -> Iterator[list]:
    """The items in blocks of at most ``most`` bytes of text (one item at least), one block at a time on the driver."""
    block: list[tuple[str, str]] = []
    held = 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("__item"), F.col(text)).where(F.col(text).isNotNull())
    for who, body in rows.orderBy(*rows.columns).toLocalIterator():
        size = len(body.encode())
        if block and held + size > most:
            yield block
            block, held = [], 0
        block.append((who, body))
        held += size
    if block:
        yield block


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = AUTOMATON_BYTES
) -> DataFrame:
    """Where test items occur in documents: key, n_words, n_hit, items (sorted), spans (code points of the original).

    Words are what remains of a text after folding A-Z and cutting at ASCII characters that are no letters or digits. Ten
    consecutive item words make a window, a shorter item is one window, an item without words none. A document word inside
    any occurrence of any window is hit. Null or empty texts have no words; null items are ignored; repeated rows are
    scanned each for itself; other columns are ignored. An empty benchmark hits nothing.

    The automaton travels with the tasks, so its items are bounded by ``most`` bytes of text. A larger benchmark is dealt
    into blocks of that size: each has its own automaton and pass, and the hit spans of a document are united.
    """
    parts = item_blocks(benchmark, text="text", most=most)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _scanned(docs, first, key, text, window)
    numbered = written(docs.select(F.col(key), F.col(text)).withColumn("__row", F.monotonically_increasing_id()), "decontam")
    named, every = numbered.withColumn("__id", F.struct(key, "__row")), None
    for part in chain((first, second), parts):
        one = written(_scanned(named, part, "__id", text, window), "scanned")
        every = one if every is None else every.unionByName(one)
    joined = every.groupBy("__id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),  # one list for each block of items
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    return _hit_words(joined.join(numbered.select(F.struct(key, "__row").alias("__id"), F.col(text).alias("__text")), "__id"), key)


def _hit_words(rows: DataFrame, key: str) -> DataFrame:
    """Counts the hit words again from united spans, which may overlap between blocks of items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            hits, spans = [], []
            for body, found in zip(utf8(block, "__text"), block.column("spans").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for s in found:
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                plain = body.decode()
                hits.append(sum(len(plain[a:b].encode().translate(FOLD).split()) for a, b in merged))
                spans.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [block.column("__key"), block.column("n_words"), pa.array(hits, pa.int64()), block.column("items"), pa.array(spans, kind)],
                names=["__key", "n_words", "n_hit", "items", "spans"],
            )

    kind = rows.schema["__id"].dataType[key].dataType.simpleString()
    flat = rows.select(F.col(f"__id.{key}").alias("__key"), "n_words", "items", "spans", "__text")
    return mapped(flat, count, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows without any occurrence of a window, with all their columns, whatever their names; one pass for each block of
    items, written but for the last. Null, empty and wordless texts stay; repeated rows fare alike; an empty table gives no
    rows, and an empty benchmark takes none."""
    parts = item_blocks(benchmark, most=most)
    part, more = next(parts, None), next(parts, None)
    while part is not None:
        shared = _shared(docs, part)

        def clean(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(shared, WINDOW)
            for block in blocks(batches, text):
                yield block.filter(pa.array([not scanner.scan(x)[1] for x in utf8(block, text)], pa.bool_()))

        docs = mapped(docs, clean, docs.schema)
        part, more = more, next(parts, None)
        if part is not None:
            docs = written(docs, "clean")
    return docs
