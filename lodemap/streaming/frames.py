"""Structured Streaming over pose rows: voxel counts and odometer chunks with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodemap.functions.geometry import cell


def voxel_counts(points: DataFrame, size: float, time: str = "ts", delay: str = "10 minutes", width: str = "10 minutes") -> DataFrame:
    """Points a voxel and time window; rows later than the watermark are left out and closed windows leave the state."""
    grid = [cell(a, size).alias(f"v{a}") for a in "xyz"]
    return points.withWatermark(time, delay).groupBy(F.window(time, width), *grid).agg(F.count("*").alias("n"))


def odometer_chunks(poses: DataFrame, length: float) -> DataFrame:
    """seq and frame where the way since the last chunk exceeds ``length``; the state of a sequence is its last position and way.

    Frames of a sequence must arrive in order from batch to batch; within a batch they are sorted.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        px, py, way = state.get if state.exists else (None, None, 0.0)
        out = []
        for row in pd.concat(list(parts)).sort_values("frame").itertuples():
            way += 0.0 if px is None else ((row.px - px) ** 2 + (row.py - py) ** 2) ** 0.5
            px, py = row.px, row.py
            if way > length:
                out.append(row.frame)
                way = 0.0
        state.update((px, py, way))
        yield pd.DataFrame({"seq": [key[0]] * len(out), "frame": out}).astype({"seq": "int64", "frame": "int32"})

    return poses.groupBy("seq").applyInPandasWithState(
        step, "seq long, frame int", "px double, py double, way double", "append", GroupStateTimeout.NoTimeout
    )
