"""Mask assignment, mask costs and losses over rows of (point, query, logit)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def assigned(scores: DataFrame, least: float, least_area: float = 0.0, key: str = "point_id") -> DataFrame:
    """key and query: each point's query of the largest sigmoid, 0-based and smaller first among equals, or -1 below ``least``.
    With ``least_area``, queries that keep a smaller share of their mask (sigmoid of one half or more) are -1 too."""
    best = scores.groupBy(key).agg(F.max_by(F.struct("query", "logit"), F.struct("logit", -F.col("query"))).alias("b"))
    best = best.select(key, F.col("b.query").alias("query"), sigmoid(F.col("b.logit")).alias("p"))
    best = best.select(key, F.when(F.col("p") >= least, F.col("query")).otherwise(-1).alias("query"))
    if not least_area:
        return best
    mask = scores.where("logit >= 0").groupBy("query").agg(F.count("*").alias("mask"))
    kept = best.groupBy("query").agg(F.count("*").alias("kept")).join(mask, "query")
    kept = kept.where(F.col("kept") >= least_area * F.col("mask")).select("query", F.lit(True).alias("ok"))
    return best.join(kept, "query", "left").select(key, F.when(F.col("ok"), F.col("query")).otherwise(-1).alias("query"))


def softmax(scores: DataFrame, key: str = "point_id") -> DataFrame:
    """Every row's share of its point's exponentials, shifted by the largest; a point has as many rows as queries."""
    per = Window.partitionBy(key)
    e = F.exp(F.col("logit") - F.max("logit").over(per))
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(per)).drop("e")


def pair_costs(scores: DataFrame, targets: DataFrame, key: str = "point_id") -> DataFrame:
    """query, target, dice and ce: costs of every query against every target (key, target), from sums over points.

    With p the sigmoid and t the target, dice is 1 - (2 Σpt + 1) / (Σp + Σt + 1), and ce the mean over all points of the
    binary cross-entropy, softplus(logit) - t·logit. Σ over a target needs its own points only, so nothing is crossed.
    """
    rows = scores.withColumn("p", sigmoid(F.col("logit"))).withColumn("soft", F.log1p(F.exp(-F.abs("logit"))) + F.greatest("logit", F.lit(0.0)))
    q = rows.groupBy("query").agg(F.sum("p").alias("sp"), F.sum("soft").alias("ss"), F.count("*").alias("n"))
    t = targets.groupBy("target").agg(F.count("*").alias("st"))
    on = rows.join(targets, key).groupBy("query", "target").agg(F.sum("p").alias("spt"), F.sum("logit").alias("slt"))
    out = on.join(q, "query").join(t, "target")
    dice = 1 - (2 * F.col("spt") + 1) / (F.col("sp") + F.col("st") + 1)
    return out.select("query", "target", dice.alias("dice"), ((F.col("ss") - F.col("slt")) / F.col("n")).alias("ce"))


def lovasz(scores: DataFrame, label: str, key: str = "point_id") -> DataFrame:
    """query and loss: the Lovász extension of 1 - IoU of softmax errors, per class that occurs (label = query).

    Errors are sorted by ranges, a class over as many as it needs. Ranks and hits count on from the sums of the ranges before,
    of which there is a row for each class; so no task sees a whole class.
    """
    p = softmax(scores, key).withColumn("fg", (F.col(label) == F.col("query")).cast("int"))
    err = F.when(F.col("fg") == 1, 1 - F.col("p")).otherwise(F.col("p"))
    rows = p.select("query", key, "fg", err.alias("err")).repartitionByRange("query", F.desc("err"), key)
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    sums = rows.groupBy("query", "part").agg(F.count("*").alias("n"), F.sum("fg").alias("f"))
    before = Window.partitionBy("query").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    every = Window.partitionBy("query")
    sums = sums.select(
        "query", "part", F.sum("f").over(every).alias("size"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"),
    ).where("size > 0")
    order = Window.partitionBy("query", "part").orderBy(F.desc("err"), key)
    e = rows.withColumns({"rank": F.row_number().over(order), "hit": F.sum("fg").over(order)}).join(F.broadcast(sums), ["query", "part"])
    j = lambda hit, rank: 1 - (F.col("size") - hit) / (F.col("size") + rank - hit)
    hit, rank = F.col("hit") + F.col("f0"), F.col("rank") + F.col("n0")
    step = j(hit, rank) - F.when(rank > 1, j(hit - F.col("fg"), rank - 1)).otherwise(F.lit(0.0))
    return e.groupBy("query").agg(F.sum(F.col("err") * step).alias("loss"))


def mask_boxes(pixels: DataFrame, label: str = "label") -> DataFrame:
    """label, bbox as x, y, w, h, and area."""
    return pixels.groupBy(label).agg(
        F.min("u").alias("x"), F.min("v").alias("y"), (F.max("u") - F.min("u") + 1).alias("w"),
        (F.max("v") - F.min("v") + 1).alias("h"), F.count("*").alias("area"),
    )


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths; every row (or column, if fewer) is paired."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        reach, via, done, row, last = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), start, -1
        settled: list[int] = []
        base = 0.0
        while True:
            through = base + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], last
            col = int(np.argmin(np.where(done, np.inf, reach)))
            base = reach[col]
            done[col] = True
            last = col
            if owner[col] < 0:
                break
            settled.append(col)
            row = int(owner[col])
        row_price[start] += base
        for c in settled:
            row_price[owner[c]] += base - reach[c]
            col_price[c] -= base - reach[c]
        while last >= 0:
            before = int(via[last])
            owner[last] = owner[before] if before >= 0 else start
            last = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)


def matched(costs: DataFrame, group: str, rows: str = "query", columns: str = "target", cost: str = "cost") -> DataFrame:
    """The assignment of least total cost in each group (a sample with some tens of queries)."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot(index=rows, columns=columns, values=cost).sort_index().sort_index(axis=1)
        pairs = assignment(table.to_numpy())
        out = pd.DataFrame({rows: [table.index[r] for r, _ in pairs], columns: [table.columns[c] for _, c in pairs]})
        out.insert(0, group, part[group].iloc[0])
        return out

    kinds = dict(costs.dtypes)
    return costs.select(group, rows, columns, cost).groupBy(group).applyInPandas(solve, ", ".join(f"{c} {kinds[c]}" for c in (group, rows, columns)))
