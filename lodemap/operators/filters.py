"""Row filters and label suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.functions.geometry import norm

#: Raw classes from here on are moving objects.
MOVING_FROM = 251


def composed(df: DataFrame, *steps) -> DataFrame:
    """Filters from left to right."""
    return reduce(DataFrame.transform, steps, df)


def static_only(df: DataFrame, sem: str = "sem", moving_from: int = MOVING_FROM) -> DataFrame:
    return df.where(F.col(sem) < moving_from)


def in_range(df: DataFrame, low: float, high: float, origin: tuple[str, str, str] | None = None) -> DataFrame:
    """Points whose distance from the origin (or from columns that hold one) is within closed bounds."""
    axes = [F.col(a) - F.col(o) for a, o in zip("xyz", origin, strict=True)] if origin else list("xyz")
    return df.where(norm(*axes).between(low, high))


def in_box(df: DataFrame, low: dict[str, Column], high: dict[str, Column], closed: bool = False) -> DataFrame:
    inside = F.lit(True)
    for a in low:
        inside = inside & (F.col(a).between(low[a], high[a]) if closed else (F.col(a) > low[a]) & (F.col(a) < high[a]))
    return df.where(inside)


def in_oriented_box(df: DataFrame, boxes: DataFrame, anti: bool = False) -> DataFrame:
    """Points inside any box (cx, cy, cz, yaw, ex, ey, ez), boundary included, or those inside none. Points meet the boxes of
    their horizontal cell alone; Spark picks the side to send by its size."""
    dx, dy = F.col("x") - F.col("b.cx"), F.col("y") - F.col("b.cy")
    c, s = F.cos("b.yaw"), F.sin("b.yaw")
    inside = (
        (F.abs(dx * c + dy * s) <= F.col("b.ex") / 2)
        & (F.abs(dy * c - dx * s) <= F.col("b.ey") / 2)
        & (F.abs(F.col("z") - F.col("b.cz")) <= F.col("b.ez") / 2)
    )
    how = "left_anti" if anti else "left_semi"
    reach = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey")) / 2
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / CELL), F.floor((F.col(c) + reach) / CELL))
    spread = boxes.withColumn("gx", F.explode(span("cx"))).withColumn("gy", F.explode(span("cy"))).alias("b")
    same = (F.floor(F.col("x") / CELL) == F.col("b.gx")) & (F.floor(F.col("y") / CELL) == F.col("b.gy"))
    return df.join(spread, same & inside, how)


#: Side of the horizontal cells, in metres.
CELL = 10.0


def by_ids(df: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """The rows that an index list names."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def suppress_small(df: DataFrame, label: str, least: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """Labels of fewer than ``least`` points become 0. Sizes are aggregated first, so a large label is no large task."""
    sizes = df.groupBy(*groups, label).count().where(F.col("count") < least).select(*groups, label, F.lit(True).alias("__small"))
    out = df.join(sizes, [*groups, label], "left")
    return out.withColumn(label, F.when(F.col("__small"), 0).otherwise(F.col(label)).cast(df.schema[label].dataType)).drop("__small")


def suppress_background(df: DataFrame, label: str, truth: str, most: float = 0.8) -> DataFrame:
    """Predicted labels that lie on true background by more than ``most`` of their points become 0."""
    share = df.groupBy(label).agg(F.avg((F.col(truth) == 0).cast("double")).alias("__share"))
    share = share.where(F.col("__share") > most).select(label, F.lit(True).alias("__off"))
    out = df.join(share, label, "left")
    return out.withColumn(label, F.when(F.col("__off"), 0).otherwise(F.col(label)).cast(df.schema[label].dataType)).drop("__off")


def keep_largest(df: DataFrame, label: str, n: int) -> DataFrame:
    """The ``n`` largest labels, smaller ids first among equals; others become -1."""
    top = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(n).select(label, F.lit(True).alias("__top"))
    out = df.join(F.broadcast(top), label, "left")  # n rows at most
    return out.withColumn(label, F.when(F.col("__top"), F.col(label)).otherwise(-1).cast(df.schema[label].dataType)).drop("__top")


def largest_to_background(df: DataFrame, label: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """The largest label of each group becomes 0; of equal ones the smallest id."""
    sizes = df.groupBy(*groups, label).count()
    top = sizes.groupBy(*groups).agg(F.max_by(label, F.struct("count", -F.col(label))).alias("__top"))
    out = df.join(top, list(groups)) if groups else df.crossJoin(F.broadcast(top))  # one row
    return out.withColumn(label, F.when(F.col(label) == F.col("__top"), 0).otherwise(F.col(label)).cast(df.schema[label].dataType)).drop("__top")


def common_labels(df: DataFrame, a: str, b: str, more_than: int = 10) -> DataFrame:
    """Labels of more than some points on both sides, without the smallest common one; others become -1 on either side."""
    left = df.groupBy(F.col(a).alias("l")).count().where(F.col("count") > more_than).select("l")
    right = df.groupBy(F.col(b).alias("l")).count().where(F.col("count") > more_than).select("l")
    both = left.join(right, "l")
    both = both.join(both.agg(F.min("l").alias("l")), "l", "left_anti")
    out = df
    for side in (a, b):
        mark = both.select(F.col("l").alias(side), F.lit(True).alias("__in"))
        out = out.join(mark, side, "left").withColumn(side, F.when(F.col("__in"), F.col(side)).otherwise(-1)).drop("__in")
    return out


def several_labels(df: DataFrame, chunk: str, label: str) -> DataFrame:
    """Chunks with more than one label."""
    kept = df.groupBy(chunk).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo <> hi").select(chunk)
    return df.join(kept, chunk, "left_semi")


def below_ground_margin(df: DataFrame, groups: tuple[str, ...] = (), margin: float = 0.6) -> DataFrame:
    """Ground points lower than the mean height of their group plus a margin."""
    means = df.groupBy(*groups).agg(F.avg("z").alias("__mean"))
    out = df.join(means, list(groups)) if groups else df.crossJoin(F.broadcast(means))  # one row
    return out.where(F.col("z") < F.col("__mean") + margin).drop("__mean")


def confident(df: DataFrame, label: str, confidence: str, top: int, least: float) -> DataFrame:
    """Rows of the ``top`` labels by mean confidence whose mean exceeds ``least``."""
    means = df.groupBy(label).agg(F.avg(confidence).alias("mean_conf")).orderBy(F.desc("mean_conf"), label).limit(top)
    return df.join(F.broadcast(means.where(F.col("mean_conf") > least)), label)


def every_kth(df: DataFrame, k: int, order: str, groups: tuple[str, ...]) -> DataFrame:
    """Every k-th row of each group in order, the first included."""
    n = F.row_number().over(Window.partitionBy(*groups).orderBy(order))
    return df.withColumn("__n", n).where((F.col("__n") - 1) % k == 0).drop("__n")
