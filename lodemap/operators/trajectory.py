"""Ordered folds and windows along trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def map_parts(df: DataFrame, frames: int = 1000, least: int = 200) -> DataFrame:
    """Maps of consecutive frames; maps of fewer than ``least`` frames are dropped."""
    out = df.withColumn("map_id", F.floor(F.col("frame") / frames).cast("long"))
    sizes = out.groupBy("seq", "map_id").count().where(F.col("count") >= least).select("seq", "map_id")
    return out.join(sizes, ["seq", "map_id"], "left_semi")


def odometer(df: DataFrame) -> DataFrame:
    """The way travelled up to each pose."""
    order = Window.partitionBy("seq").orderBy("frame")
    step = F.sqrt(
        F.pow(F.col("px") - F.lag("px").over(order), 2) + F.pow(F.col("py") - F.lag("py").over(order), 2)
    )
    return df.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("way", F.sum("step").over(order))


def odometer_chunks(df: DataFrame, length: float) -> DataFrame:
    """seq and frame of the poses at which the way since the last chunk exceeds ``length``; there it begins again.

    The sum restarts where it pays out, so no running sum gives it: each trajectory is folded in order. A trajectory is one
    drive, whose poses (not points) are gathered in one row.
    """
    steps = odometer(df).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("frame", "step"))).alias("steps"))
    start = F.struct(F.lit(0.0).alias("way"), F.array().cast("array<int>").alias("at"))

    def fold(state, pose):
        way = state["way"] + pose["step"]
        passed = way > length
        return F.struct(
            F.when(passed, 0.0).otherwise(way).alias("way"),
            F.when(passed, F.concat(state["at"], F.array(pose["frame"]))).otherwise(state["at"]).alias("at"),
        )

    return steps.select("seq", F.explode(F.aggregate("steps", start, fold)["at"]).alias("frame"))


def frame_window(df: DataFrame, before: int, after: int) -> DataFrame:
    """The frames from ``before`` before each one up to ``after`` after it (exclusive), in order."""
    order = Window.partitionBy("seq").orderBy("frame").rowsBetween(-before, after - 1)
    return df.withColumn("frames", F.collect_list("frame").over(order))


def pose_subsample(df: DataFrame, step: float = 1.0) -> DataFrame:
    """Poses that are the nearest one to a grid node and nearer than half a step to it on each axis."""
    least = df.groupBy("seq").agg(F.min("px").alias("mx"), F.min("py").alias("my"))
    at = df.join(least, "seq")
    node = {f"n{a}": F.rint((F.col(f"p{a}") - F.col(f"m{a}")) / step).cast("long") for a in "xy"}
    at = at.withColumns(node)
    off = {f"d{a}": F.abs(F.col(f"p{a}") - F.col(f"m{a}") - F.col(f"n{a}") * step) for a in "xy"}
    at = at.withColumns(off).where((F.col("dx") < step / 2) & (F.col("dy") < step / 2))
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    return at.groupBy("seq", "nx", "ny").agg(F.min_by("frame", F.struct(F.round(d2, 9), "frame")).alias("frame")).select("seq", "frame")


def chunk_frames(chunks: DataFrame, poses: DataFrame, radius: float) -> DataFrame:
    """The frames of a sequence nearer than ``radius`` to a chunk's centre, by cells of that size."""
    near = lambda c: F.explode(F.array(*(F.floor(F.col(c) / radius) + i for i in (-1, 0, 1))))
    c = chunks.select(F.col("seq"), F.col("frame").alias("chunk"), F.col("px").alias("cx"), F.col("py").alias("cy"))
    c = c.withColumn("gx", near("cx")).withColumn("gy", near("cy"))
    p = poses.withColumn("gx", F.floor(F.col("px") / radius)).withColumn("gy", F.floor(F.col("py") / radius))
    d2 = F.pow(F.col("px") - F.col("cx"), 2) + F.pow(F.col("py") - F.col("cy"), 2)
    return c.join(p, ["seq", "gx", "gy"]).where(d2 < radius * radius).select("seq", "chunk", "frame")
