"""Byte-level BPE by rank: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mapped, sha256_hex, strings
from .pieces import Cutter

#: Bytes of pre-tokens and packed ids that a worker remembers, without what Python needs to hold them (some 200 bytes each,
#: counted as such); beyond it those that came only once are forgotten.
REMEMBERED, EACH = 96_000_000, 200
#: Bytes of text that are cut and encoded at once; a longer text makes a step of its own.
BLOCK_BYTES = 500_000
#: A rank file of more bytes isn't sent to the executors.
RANK_FILE_BYTES = 64_000_000


class PerfectHash:
    """A minimal perfect hash over distinct byte strings: as many slots as keys, one displacement a bucket.

    Keys go to buckets by one part of a 64-bit hash. Buckets are placed from the largest down, each with the first
    displacement that sends all of its keys to free slots; a bucket of one key takes any free slot, written as ``-slot - 1``.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // 4)
        self.displacement = np.zeros(self.buckets, np.int64)
        self.slot_key = np.full(self.size, -1, np.int64)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            groups.setdefault(b, []).append(i)
        order = sorted(groups.items(), key=lambda g: -len(g[1]))
        taken = np.zeros(self.size, bool)
        single = next((n for n, g in enumerate(order) if len(g[1]) == 1), len(order))
        tries = np.arange(1, 2049, dtype=np.uint64)[:, None]
        for bucket, members in order[:single]:
            base = 0
            while True:
                slots = self._slots(hashes[members][None, :], tries + np.uint64(base))
                free = ~taken[slots].any(axis=1)
                for row in np.flatnonzero(free):
                    if len(set(slots[row].tolist())) == len(members):
                        break
                else:
                    base += len(tries)
                    continue
                break
            taken[slots[row]] = True
            self.displacement[bucket] = base + int(row) + 1
            self.slot_key[slots[row]] = members
        for (bucket, (member,)), slot in zip(order[single:], np.flatnonzero(~taken).tolist(), strict=False):
            self.displacement[bucket] = -slot - 1
            self.slot_key[slot] = member

    def _slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (displacement * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The number of the key that owns each one's slot; the caller compares the strings."""
        if not self.size:
            return np.full(len(keys), -1)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        shift = self.displacement[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -shift - 1, self._slots(hashes, np.abs(shift).astype(np.uint64)))
        return self.slot_key[slots]


class BytePairCoder:
    """Encodes and decodes by ranks, as lines of base64 and number; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.rank = dict(zip(self.tokens, self.ids, strict=True))
        self.bytes_of = dict(zip(self.ids, self.tokens, strict=True))
        self.digits = {i: str(i) for i in self.ids}
        self.whole = PerfectHash(self.tokens)
        self.cut = Cutter(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.again: set[str] = set()
        self.held = 0

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: its parts are a linked list, the heap yields the pair of lowest rank, leftmost first."""
        n, rank = len(piece), self.rank
        get, push, pop = rank.get, heapq.heappush, heapq.heappop
        end = list(range(1, n + 1))  # where the part that begins here ends; 0: it has been swallowed
        before = list(range(-1, n - 1))
        # an entry is one number, of rank, beginning and end: numbers compare faster than tuples, in the same order
        bits = n.bit_length()
        last, both = (1 << bits) - 1, 2 * bits
        heap = [r << both | i << bits | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, stop = entry >> bits & last, entry & last
            j = end[i]
            if not j or j >= n or end[j] != stop:  # one of its parts has grown since
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = get(piece[i : end[stop]])
                if r is not None:
                    push(heap, r << both | i << bits | end[stop])
            h = before[i]
            if h >= 0:
                r = get(piece[h:stop])
                if r is not None:
                    push(heap, r << both | h << bits | stop)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pre-tokens into ``known``. When that is full, it keeps what came again since the last time and what
        is needed now; only the latter if that would still fill half of it."""
        new = pieces.difference(self.known)
        raw = [p.encode() for p in new]
        more = sum(map(len, raw)) + EACH * len(raw)
        if self.held + more > REMEMBERED:
            for keep in (self.again | pieces, pieces):
                self.known = {p: self.known[p] for p in keep if p in self.known}
                self.held = sum(map(len, self.known)) + EACH * len(self.known)
                if self.held <= REMEMBERED // 2:
                    break
            self.again = set()
        else:
            self.again |= pieces - new
        self.held += more
        for p, b, k in zip(new, raw, self.whole.lookup(raw).tolist() if raw else [], strict=True):
            self.known[p] = (self.ids[k],) if k >= 0 and self.tokens[k] == b else self.merge(b)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text: each match of the pattern by itself, no special tokens."""
        cut = [self.cut(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        of = self.known.__getitem__
        for pieces in cut:
            yield list(chain.from_iterable(map(of, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _built(digest: str, ranks: bytes, pattern: str) -> BytePairCoder:
    return BytePairCoder(ranks, pattern)


def shared_coder(df: DataFrame, path: str, pattern: str) -> Broadcast:
    """The coder of a rank file, whose size is checked, built once on the driver; workers keep what they learn."""
    with open(path, "rb") as file:
        data = file.read(RANK_FILE_BYTES + 1)
    if len(data) > RANK_FILE_BYTES:
        raise ValueError(f"{path} has more than {RANK_FILE_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(_built(hashlib.sha256(data).hexdigest(), data, pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``ids array<int>`` of every whole text. Null and empty texts have no ids; repeated rows are encoded each for
    itself; other columns are ignored, whatever their names; an empty table gives no rows."""
    shared = shared_coder(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for block in blocks(batches, "__text", BLOCK_BYTES):
            ids = pa.array(list(coder.encode(strings(block, "__text"))), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([block.column(0), ids], names=["__key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return mapped(rows, run, f"__key {kind}, ids array<int>").withColumnRenamed("__key", key)


def decode(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and ``decoded binary`` of id arrays; null has no bytes, an id that the ranks lack is an error."""
    shared = shared_coder(encoded, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            raw = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["__key", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("__key"), F.col(ids).alias("__ids"))
    return mapped(rows, run, f"__key {kind}, decoded binary").withColumnRenamed("__key", key)


def round_trip_digests(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns key, n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 (of the decoded bytes); with ``keep_ids`` the ids too. Rows as in ``encode``."""
    shared = shared_coder(docs, ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for block in blocks(batches, "__text", BLOCK_BYTES):
            counts, shas, back, kept = [], [], [], []
            for ids in coder.encode(strings(block, "__text")):
                counts.append(len(ids))
                shas.append(sha256_hex(",".join(map(coder.digits.__getitem__, ids)).encode()))
                back.append(sha256_hex(coder.decode(ids)))
                if keep_ids:
                    kept.append(array("i", ids))
            columns = [block.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = ["__key", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(kept), np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    more = ", ids array<int>" if keep_ids else ""
    out = mapped(rows, run, f"__key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("__key", key)
