"""Seeded sampling, augmentation and ground planes."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sampled(df: DataFrame, n: int, seed: int, key: str = "point_id") -> DataFrame:
    """``n`` rows without replacement: those of least seeded hash, so the same ones on every run and partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def sampled_per_group(df: DataFrame, n: int, seed: int, group: str, key: str = "point_id") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).drop("__k")


def _unit(seed: int, salt: int, chunk: str) -> F.Column:
    """A number in [0, 1) of a chunk."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), chunk), F.lit(1 << 30)) / float(1 << 30)


def augmented(df: DataFrame, chunk: str, seed: int, shift: float = 0.1) -> DataFrame:
    """Each chunk turned about z, mirrored in one of four ways, scaled by 0.95 to 1.05 and shifted by normal steps."""
    yaw = _unit(seed, 0, chunk) * (2 * math.pi)
    mirror = F.floor(_unit(seed, 1, chunk) * 4)
    fx = F.when(mirror.isin(1, 3), -1.0).otherwise(1.0)
    fy = F.when(mirror.isin(2, 3), -1.0).otherwise(1.0)
    scale = 0.95 + 0.1 * _unit(seed, 2, chunk)
    step = {  # two uniform numbers make a normal one
        a: shift * F.sqrt(-2 * F.log(1 - _unit(seed, 3 + 2 * i, chunk))) * F.cos(2 * math.pi * _unit(seed, 4 + 2 * i, chunk))
        for i, a in enumerate("xyz")
    }
    x, y = F.col("x") * fx, F.col("y") * fy
    turned = {"x": x * F.cos(yaw) - y * F.sin(yaw), "y": x * F.sin(yaw) + y * F.cos(yaw), "z": F.col("z")}
    return df.withColumns({a: turned[a] * scale + step[a] for a in "xyz"})


def ground_planes(df: DataFrame, frame: str, within: float = 0.4, rounds: int = 2000, seed: int = 0, key: str = "point_id") -> DataFrame:
    """key and is_ground: points near the plane through three points that has the most points near it, per frame. Draws are
    seeded by the frame, and the first best plane stays."""

    def mark(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        xyz = part[["x", "y", "z"]].to_numpy(float)
        near = np.zeros(len(xyz), bool)
        rng = np.random.default_rng([seed, zlib.crc32(str(part[frame].iloc[0]).encode())])
        for _ in range(rounds if len(xyz) >= 3 else 0):
            a, b, c = xyz[rng.choice(len(xyz), 3, replace=False)]
            normal = np.cross(b - a, c - a)
            size = np.linalg.norm(normal)
            if size > 1e-12:
                found = np.abs((xyz - a) @ (normal / size)) <= within
                near = found if found.sum() > near.sum() else near
        return pd.DataFrame({key: part[key], "is_ground": near})

    kinds = dict(df.dtypes)
    return df.select(frame, key, *"xyz").groupBy(frame).applyInPandas(mark, f"{key} {kinds[key]}, is_ground boolean")
