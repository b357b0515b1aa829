"""Linked lists of samples, splits and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sets import dense_ids
from .stages import cut


def chained(samples: DataFrame, token: str = "token", after: str = "next") -> DataFrame:
    """token, head (the first one of its list) and place (from 0) of rows that name the next one; null ends a list.

    Each round every token jumps twice as far back, so the rounds are logarithmic in the longest list; one that never ends (a
    ring) is an error.
    """
    links = samples.select(F.col(token).alias("t"), F.col(after).alias("n"))
    back = links.where("n is not null").select(F.col("n").alias("t"), F.col("t").alias("p"))
    rows = links.select("t").distinct().join(back, "t", "left").select("t", "p", F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("d"))
    rows = cut(rows)
    rounds = max(1, rows.count()).bit_length() + 1
    for _ in range(rounds):
        if rows.where("p is not null").isEmpty():
            break
        up = rows.select(F.col("t").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        # the furthest token found so far stays where its own list begins
        rows = cut(rows.join(up, "p", "left").select("t", F.col("pp").alias("p"), (F.col("d") + F.coalesce("dd", F.lit(0))).alias("d")))
    if not rows.where("p is not null").isEmpty():
        raise ValueError("the samples' links form a ring")
    return rows.select(F.col("t").alias(token), F.col("d").alias("place"))


def in_split(rows: DataFrame, splits: dict[str, list[int]], split: str, sequence: str = "seq") -> DataFrame:
    """The rows of the sequences of a split."""
    return rows.where(F.col(sequence).isin(splits[split]))


def batches(rows: DataFrame, size: int, key: str, seed: int | None = None) -> DataFrame:
    """The rows with ``batch`` and ``slot``: in the order of the key, or shuffled by its hash with a seed. The last batch may be
    smaller."""
    order = F.struct(key) if seed is None else F.struct(F.xxhash64(F.lit(seed), F.col(key)), key)
    placed = dense_ids(rows.withColumn("__order", order), "__order", "__place").drop("__order")
    return placed.withColumns({"batch": F.expr(f"__place div {size}"), "slot": F.expr(f"__place % {size}")}).drop("__place")
