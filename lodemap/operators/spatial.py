"""Radius, band and nearest-neighbour joins over grid cells: equi-joins on cells, then an exact distance test."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodemap.functions.geometry import cell, squared_distance

from .stages import cut


#: Left rows of a nearest-neighbour search, at most, that are compared with all right rows, where the rounds have left them.
STRAYS = 500
#: Neighbours asked for, times this, is the most that a point's cell holds on the average when a nearest-neighbour search begins.
CROWD = 2
#: Halvings of its first radius, at most.
HALVINGS = 40


def _near_cells(size: float, side: str, flat: str = "") -> Column:
    steps = product(*((0,) if a in flat else (-1, 0, 1) for a in "xyz"))
    offsets = [F.struct(*(cell(f"{side}_{a}", size) + F.lit(d).cast("long") for a, d in zip("xyz", o, strict=True))) for o in steps]
    return F.explode(F.array(*offsets)).alias("cell")


def grid_join(left: DataFrame, right: DataFrame, radius: float, keys: tuple[str, ...] = (), flat: str = "") -> DataFrame:
    """Pairs within ``radius`` (closed), and ``d2``. Columns are prefixed ``l_`` and ``r_``; ``keys`` must be equal.

    The left side is replicated to the 27 cells around it, so put the smaller side there; along the axes named in ``flat``, of
    which all rows of both sides have one value, its own cell will do.
    """
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    a = a.select("*", _near_cells(radius, "l", flat))
    b = b.withColumn("cell_r", F.struct(*(cell(f"r_{c}", radius) for c in "xyz")))
    same = reduce(lambda s, k: s & (F.col(f"l_{k}") == F.col(f"r_{k}")), keys, F.col("cell") == F.col("cell_r"))
    d2 = squared_distance([F.col(f"l_{c}") for c in "xyz"], [F.col(f"r_{c}") for c in "xyz"])
    return a.join(b, same).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("cell", "cell_r")


def self_pairs(df: DataFrame, radius: float, key: str = "point_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """Each unordered pair of different points within ``radius`` once."""
    return grid_join(df, df, radius, keys).where(F.col(f"l_{key}") < F.col(f"r_{key}"))


def knn_join(
    left: DataFrame, right: DataFrame, k: int, start: float, key: str = "point_id", most: float | None = None, keys: tuple[str, ...] = (),
    other: str | None = None,
) -> DataFrame:
    """The ``k`` nearest right rows of every left row, by distance and then the right side's key (``other``, if it has another
    name), with ``rank`` from 1.

    The radius begins at ``start``, or at a smaller one where the right side is dense (``_uncrowded``), and doubles for the rows
    that have fewer than ``k`` neighbours within it; a row is done when its k-th is, so the answer is exact. The last ``STRAYS`` rows, far from all others, are compared with the whole right side.
    ``most`` bounds the distance (closed). Where the right side has fewer than ``k`` rows no radius will do, so the first one
    spans everything.
    """
    both = left.select(*"xyz").unionByName(right.select(*"xyz"))
    box = both.agg(*(F.max(a) - F.min(a) for a in "xyz")).first()
    flat = "".join(a for a, v in zip("xyz", box, strict=True) if v == 0)
    extent = sum(v * v for v in box if v is not None) ** 0.5 * (1 + 1e-9)  # the square of a root may fall short of it
    limit = extent if most is None else min(most, extent)
    order = Window.partitionBy(f"l_{key}").orderBy("d2", f"r_{other or key}")
    done, todo, radius = [], left, min(start, max(limit, 1e-9)) if most is None else most
    if most is None and right.limit(k).count() < k:
        radius = max(limit, 1e-9)
    elif most is None:
        radius, right = _uncrowded(right, radius, k, keys, other or key, flat)
    while True:
        found = grid_join(todo, right, radius, keys, flat)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if radius >= limit:
            done.append(found)
            break
        found = cut(found)  # a round is run once, not again in every later one
        full = found.where(F.col("rank") == k).select(F.col(f"l_{key}").alias(key))
        done.append(found.join(full.select(F.col(key).alias(f"l_{key}")), f"l_{key}", "left_semi"))
        todo = cut(todo.join(full, key, "left_anti"))
        left_over = todo.count()
        if not left_over:
            break
        if left_over <= STRAYS:
            found = _against_all(todo, right, k, keys)
            found = found if most is None else found.where(F.col("d2") <= most * most)
            done.append(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            break
        radius = min(2 * radius, max(limit, 1e-9))
    return reduce(DataFrame.unionByName, done)


def _uncrowded(right: DataFrame, radius: float, k: int, keys: tuple[str, ...], key: str, flat: str) -> tuple[float, DataFrame]:
    """A radius for the first round of a search, ``radius`` at most, by which a row meets some multiple of ``k`` others, and the
    right rows that such a search needs: of more than ``k`` rows in one place, those of least key."""
    axes = 3 - len(flat)

    def crowd(size: float) -> float:  # the rows of a cell, as the average row has it
        held = right.groupBy(*keys, *(cell(a, size).alias(f"__{a}") for a in "xyz")).agg(F.count("*").cast("double").alias("c"))
        return held.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 0.0

    least, now = radius / 2**HALVINGS, crowd(radius)
    if now <= CROWD * k:
        return radius, right
    places = [*keys, *"xyz"]
    if right.groupBy(*places).count().where(F.col("count") > k).limit(1).count():
        order = Window.partitionBy(*places).orderBy(key)
        right = cut(right.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__place"))
        now = crowd(radius)
    while now > CROWD * k and axes and radius > least:
        radius /= 2 ** max(1, int(np.log2(now / (CROWD * k)) / axes))
        now = crowd(radius)
    return radius, right


def _against_all(few: DataFrame, right: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """As ``grid_join`` without a radius, for ``STRAYS`` left rows at most: they are sent to the right side, of which each batch
    gives the k nearest of every left row back."""
    few = cut(few.withColumn("__left", F.monotonically_increasing_id()))
    rows = few.select("__left", *"xyz", *keys).toPandas()
    at = rows[["x", "y", "z"]].to_numpy(float)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            d2 = sum((at[:, None, i] - part[a].to_numpy(float)[None]) ** 2 for i, a in enumerate("xyz"))
            for c in keys:
                d2 = np.where(rows[c].to_numpy()[:, None] == part[c].to_numpy()[None], d2, np.inf)
            kth = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, [min(k, d2.shape[1]) - 1]]
            who, which = np.nonzero((d2 <= kth) & np.isfinite(d2))  # with all that tie for the last place
            out = part.iloc[which].add_prefix("r_").assign(d2=d2[who, which], __left=rows["__left"].to_numpy()[who])
            yield out[[*(f"r_{c}" for c in part.columns), "d2", "__left"]]

    schema = StructType([*(StructField(f"r_{f.name}", f.dataType) for f in right.schema), StructField("d2", DoubleType())])
    found = right.mapInPandas(nearest, schema.add("__left", "long"))
    own = few.select("__left", *(F.col(c).alias(f"l_{c}") for c in few.columns if c != "__left"))
    return F.broadcast(own).join(found, "__left").drop("__left")


def nearest_value(left: DataFrame, right: DataFrame, value: str, start: float, most: float | None = None, default=None, key: str = "point_id") -> DataFrame:
    """Every left row with the value of its nearest right row, or ``default`` where none is within ``most``."""
    found = knn_join(left, right, 1, start, key, most).select(F.col(f"l_{key}").alias(key), F.col(f"r_{value}").alias(value))
    out = left.drop(value).join(found, key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def near_any(left: DataFrame, right: DataFrame, radius: float, anti: bool = False, key: str = "point_id") -> DataFrame:
    """Left rows with (or without) a right row nearer than ``radius``."""
    ids = grid_join(left, right, radius).where(F.col("d2") < radius * radius).select(F.col(f"l_{key}").alias(key)).distinct()
    return left.join(ids, key, "left_anti" if anti else "left_semi")


def interpolated(left: DataFrame, right: DataFrame, value: str, k: int, start: float, key: str = "point_id") -> DataFrame:
    """The mean value of the k nearest, weighted by inverse squared distance."""
    weight = 1.0 / (F.col("d2") + 1e-8)
    found = knn_join(left, right, k, start, key)
    return found.groupBy(F.col(f"l_{key}").alias(key)).agg((F.sum(F.col(f"r_{value}") * weight) / F.sum(weight)).alias(value))


def mean_feature(left: DataFrame, right: DataFrame, feature: str, radius: float, size: int, key: str = "point_id") -> DataFrame:
    """The mean feature array of the right rows within ``radius``; zeros where there is none."""
    pairs = grid_join(left.select(key, *"xyz"), right, radius)
    means = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(*(F.avg(F.col(f"r_{feature}")[i]).alias(f"m{i}") for i in range(size)))
    means = means.select(key, F.array(*(F.col(f"m{i}") for i in range(size))).alias("mean_feature"))
    zeros = F.array(*(F.lit(0.0) for _ in range(size)))
    return left.join(means, key, "left").withColumn("mean_feature", F.coalesce("mean_feature", zeros))


def statistical_inliers(df: DataFrame, neighbours: int, ratio: float, start: float, key: str = "point_id") -> DataFrame:
    """Points whose mean distance to their nearest neighbours (themselves included) is below the mean of all plus ``ratio``
    sample deviations."""
    found = knn_join(df.select(key, *"xyz"), df.select(key, *"xyz"), neighbours, start, key)
    own = found.groupBy(F.col(f"l_{key}").alias(key)).agg(F.avg(F.sqrt("d2")).alias("mean_d"))
    bound = own.agg((F.avg("mean_d") + ratio * F.stddev_samp("mean_d")).alias("bound"))
    return df.join(own.crossJoin(F.broadcast(bound)).where("mean_d < bound").select(key), key, "left_semi")  # one row


def depth_visible(df: DataFrame, k: int, start: float, key: str = "point_id") -> DataFrame:
    """Depth scores against the k nearest in (x, y): exp(-((z - least) / (largest - least))²), and whether it exceeds the mean."""
    flat = df.select(key, "x", "y", F.lit(0.0).alias("z"), F.col("z").alias("depth"))
    found = knn_join(flat, flat, k, start, key)
    own = found.groupBy(F.col(f"l_{key}").alias(key), F.col("l_depth").alias("depth"))
    own = own.agg(F.min("r_depth").alias("lo"), F.max("r_depth").alias("hi"))
    share = (F.col("depth") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    scored = own.select(key, F.exp(-F.coalesce(share * share, F.lit(0.0))).alias("score"))
    mean = scored.agg(F.avg("score").alias("mean"))
    return scored.crossJoin(F.broadcast(mean)).select(key, "score", (F.col("score") > F.col("mean")).alias("visible"))  # one row
