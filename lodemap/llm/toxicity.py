"""Toxicity by a factorization machine over hashed terms: linear weights and learned pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, mapped, rest, utf8, written
from .decontam import FOLD

#: Labelled rows to learn from, at most, of each class; by hash of the key, so the same ones on every run.
TRAIN_TOXIC, TRAIN_CLEAN = 4_000, 8_000
#: Terms of all these rows, at most, that the driver learns from: of the rows by hash, those before this many.
TRAIN_TERMS = 30_000_000
#: Terms are hashed to as many numbers.
BUCKETS = 1 << 24
#: Bytes of a word's beginning that is a term too, if the word is longer.
BEGINNING = 5
FACTORS, EPOCHS, BATCH, SEED = 4, 6, 64, 7
#: Rates of the linear weights, the factors and the bias; the pull that a linear weight needs to leave zero; the squared
#: gradients that factors begin with, so that rare terms learn slowly.
LINEAR_RATE, FACTOR_RATE, BIAS_RATE, SPARSE, CALM = 3.0, 0.1, 0.1, 8.0, 10.0
#: A score from here on is a prediction of toxicity.
THRESHOLD = 0.7


def terms(text: bytes) -> set[bytes]:
    """Distinct terms: words, A-Z folded, cut at ASCII characters that are no letters or digits; and beginnings of long words,
    marked by a character that no word has."""
    words = set(text.translate(FOLD).split())
    return words | {b"^" + w[:BEGINNING] for w in words if len(w) > BEGINNING}


def bucket(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % BUCKETS


@dataclass
class FactorizationMachine:
    """score = σ(bias + Σ wᵢ + Σ_{i<j} ⟨vᵢ, vⱼ⟩ / √n) over the buckets of a text's n distinct terms; those of no labelled text
    have neither weight nor factors. The root keeps a long text's many pairs from drowning the few that tell."""

    buckets: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def rows(self, found: np.ndarray) -> np.ndarray:
        """The row of each bucket, or -1."""
        if not len(self.buckets):
            return np.full(len(found), -1)
        at = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        return np.where(self.buckets[at] == found, at, -1)

    def sums(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The factors of the rows, their sum for each text, and the texts' scores; ``sizes``: rows of each text, in order."""
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        v = self.factors[rows]
        total = np.zeros((len(sizes), self.factors.shape[1]), np.float32)
        raw = np.full(len(sizes), self.bias)
        if len(full):
            total[full] = np.add.reduceat(v, starts, axis=0)
            own = np.add.reduceat((v * v).sum(1), starts)
            raw[full] += np.add.reduceat(self.linear[rows], starts)
            raw[full] += 0.5 * ((total[full] ** 2).sum(1) - own) / np.sqrt(sizes[full])
        return v, total, 1 / (1 + np.exp(-np.clip(raw, -60, 60)))

    def score_texts(self, texts: list[bytes]) -> np.ndarray:
        found = [terms(t) for t in texts]
        distinct = list(set().union(*found))
        rows = self.rows(np.fromiter(map(bucket, distinct), np.int64, len(distinct)))
        known = {t: r for t, r in zip(distinct, rows.tolist(), strict=True) if r >= 0}
        own = [{known[t] for t in x if t in known} for x in found]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return self.sums(np.fromiter(chain.from_iterable(own), np.int64, int(sizes.sum())), sizes)[2]


def fit(examples: list[tuple[np.ndarray, int]]) -> FactorizationMachine:
    """Learns from pairs of a text's buckets and its label; the same examples give the same machine.

    The logistic loss is minimised in batches: linear weights by a follow-the-leader step that keeps a weight at zero until
    its terms pull hard enough, factors by AdaGrad. Every term takes part, whatever it says by itself.
    """
    buckets = np.unique(np.concatenate([t for t, _ in examples])) if examples else np.zeros(0, np.int64)
    rng, m = np.random.default_rng(SEED), len(buckets)
    model = FactorizationMachine(buckets, 0.0, np.zeros(m, np.float32), rng.normal(0, 0.01, (m, FACTORS)).astype(np.float32))
    if not m:
        toxic = sum(y for _, y in examples)
        model.bias = float(np.log((toxic + 1) / (len(examples) - toxic + 1)))
        return model
    rows = [np.unique(model.rows(t)) for t, _ in examples]
    labels = np.array([y for _, y in examples], np.float32)
    pull, seen_linear = np.zeros(m, np.float32), np.zeros(m, np.float32)
    seen_factors, seen_bias = np.full((m, FACTORS), CALM, np.float32), 1.0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            sizes = np.array([len(rows[i]) for i in part])
            flat, owner = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), sizes)
            v, total, score = model.sums(flat, sizes)
            error = (score - labels[part]).astype(np.float32)
            seen_bias += float(error.sum()) ** 2
            model.bias -= BIAS_RATE * float(error.sum()) / np.sqrt(seen_bias)
            if not len(flat):
                continue
            by = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.diff(flat[by], prepend=-1))
            used = flat[by][starts]
            slope = np.add.reduceat(error[owner][by], starts)
            before, after = seen_linear[used], seen_linear[used] + slope**2
            pull[used] += slope - (np.sqrt(after) - np.sqrt(before)) / LINEAR_RATE * model.linear[used]
            free = np.maximum(np.abs(pull[used]) - SPARSE, 0)
            model.linear[used] = -np.sign(pull[used]) * free * LINEAR_RATE / (1 + np.sqrt(after))
            seen_linear[used] = after
            slopes = (error / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)[owner, None] * (total[owner] - v)
            slopes = np.add.reduceat(slopes[by], starts, axis=0)
            seen_factors[used] += slopes**2
            model.factors[used] -= FACTOR_RATE * slopes / np.sqrt(seen_factors[used])
    return model


def held_out(key: str) -> F.Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def examples(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list[tuple[np.ndarray, int]]:
    """A bounded sample of labelled texts outside the held-out third, as the buckets of all their terms and their label.

    Rows without key or label are left out; of labels that disagree about a key the toxic one counts, and of rows that repeat a
    key the one of least buckets. Empty texts are examples without terms.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    known = known.groupBy(F.col(key).alias("__key")).agg(F.max("toxic").cast("int").alias("toxic"))
    toxic = known.where("toxic = 1").orderBy(F.xxhash64("__key"), "__key").limit(TRAIN_TOXIC)
    clean = known.where("toxic = 0").orderBy(F.xxhash64("__key"), "__key").limit(TRAIN_CLEAN)
    chosen = F.broadcast(toxic.unionByName(clean))  # TRAIN_TOXIC + TRAIN_CLEAN rows at most
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(chosen, "__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            hashed = [np.unique(np.fromiter(map(bucket, terms(x)), np.int32)) for x in utf8(block, "__text")]
            columns = [block.column("__key"), block.column("toxic"), pa.array([x.tobytes() for x in hashed], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__key", "toxic", "terms"])

    kind = rows.schema["__key"].dataType.simpleString()
    hashed = mapped(rows, run, f"__key {kind}, toxic int, terms binary")
    texts = written(hashed.groupBy("__key", "toxic").agg(F.min("terms").alias("terms")), "labelled")
    order = Window.orderBy(F.xxhash64("__key"), "__key")  # TRAIN_TOXIC + TRAIN_CLEAN rows at most
    sizes = texts.select("__key", F.sum(F.length("terms") / 4).over(order).alias("before")).where(F.col("before") <= TRAIN_TERMS)
    found = texts.join(F.broadcast(sizes), "__key").select("__key", "toxic", "terms").toArrow().sort_by("__key")
    discard(texts)
    rest(docs.sparkSession)
    bodies, toxic = found.column("terms").to_pylist(), found.column("toxic").to_pylist()
    return [(np.frombuffer(b, np.int32), y) for b, y in zip(bodies, toxic, strict=True)]


def score(docs: DataFrame, model: FactorizationMachine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score (0 to 1) and predicted (1 from ``THRESHOLD`` on) of every whole text.

    Null and empty texts get the score of the bias alone. Repeated rows are scored each for itself, other columns are
    ignored, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            found = shared.value.score_texts(utf8(block, "__text"))
            hard = (found >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found), pa.array(hard)], names=["__key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return mapped(rows, run, f"__key {kind}, score double, predicted int").withColumnRenamed("__key", key)


def without_toxic(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """The rows below the threshold, with all their columns, whatever their names. Null and empty texts have the score of the
    bias alone, and go only if that reaches the threshold; repeated rows fare alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.filter(pa.array(shared.value.score_texts(utf8(block, text)) < THRESHOLD, pa.bool_()))

    return mapped(docs, run, docs.schema)
