"""Unions, index sets, dense ids and collation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut


def united(clouds: list[DataFrame], key: str = "point_id") -> DataFrame:
    """All clouds with their number as ``part``; of points at equal coordinates the first by part and key stays."""
    every = reduce(DataFrame.unionByName, (c.withColumn("part", F.lit(i)) for i, c in enumerate(clouds)))
    return every.groupBy("x", "y", "z").agg(F.min_by(F.struct(*every.columns), F.struct("part", key)).alias("row")).select("row.*")


def index_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection (both), union (either) and difference (first) of two index lists."""
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first": a.subtract(b)}
    return reduce(DataFrame.unionByName, (p.select(F.lit(n).alias("part"), *p.columns) for n, p in parts.items()))


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ids from 0 in the order of distinct values. The values are sorted by range and numbered from counts of each range, so
    no task sees them all."""
    values = df.select(column).distinct().repartitionByRange(column).withColumn("__part", F.spark_partition_id())
    values = cut(values)  # the ranges must not be drawn anew
    sizes = values.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    ids = values.withColumn("__rank", rank).join(F.broadcast(sizes), "__part")
    return df.join(ids.select(column, (F.col("__before") + F.col("__rank") - 1).alias(name)), column)


def collated(df: DataFrame, groups: tuple[str, ...], columns: list[str], order: str) -> DataFrame:
    """A row for each sample with parallel arrays; a sample is a training item, so its rows fit in one."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return df.groupBy(*groups).agg(rows.alias("__rows")).select(*groups, *(F.col("__rows")[c].alias(c) for c in columns))
