"""Stages that build a map from scans: transformed, split by ground, thinned to voxels, labelled from the full cloud."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions.geometry import transformed

from . import voxel
from .sets import dense_ids
from .spatial import knn_join


def aggregated(points: DataFrame, poses: DataFrame) -> DataFrame:
    """The points of all frames in the world frame, by the poses (frame, pose); the other columns, such as ``is_ground`` and
    labels, stay beside them. Frames without a pose are left out. Poses are a row a frame, points millions."""
    moved = points.join(poses.select("frame", "pose"), "frame")
    columns = [c for c in points.columns if c not in "xyz"]
    return moved.select(*columns, *(c.alias(a) for a, c in zip("xyz", transformed("pose"), strict=True)))


def thinned(cloud: DataFrame, size: float, labels: tuple[str, ...], ground: str = "is_ground", key: str = "point_id") -> DataFrame:
    """ground, the voxel (vx, vy, vz), its mean point, its count ``n``, and the labels of the full cloud's point nearest to
    that mean on the same side of the ground; of points at one distance that of the least key. One join carries all labels."""
    minor = voxel.downsample(cloud, size, (ground,))
    own = F.struct(ground, "vx", "vy", "vz").alias("voxel")
    near = knn_join(minor.select(own, ground, *"xyz"), cloud.select(key, ground, *"xyz", *labels), 1, size, "voxel", keys=(ground,), other=key)
    found = near.select(F.col("l_voxel").alias("voxel"), *(F.col(f"r_{c}").alias(c) for c in labels))
    return minor.join(found.select("voxel.*", *labels), [ground, "vx", "vy", "vz"])


def with_delimiters(frames: DataFrame, frame: str = "frame", key: str = "point_id") -> DataFrame:
    """The rows of all frames, each frame followed by a row whose other columns are null, as ``row`` from 0 numbers them."""
    ends = frames.select(frame).distinct().select(frame, *(F.lit(None).cast(t).alias(c) for c, t in frames.dtypes if c != frame))
    every = frames.withColumn("end", F.lit(0)).unionByName(ends.withColumn("end", F.lit(1)))
    every = every.withColumn("__at", F.struct(frame, "end", key))
    return dense_ids(every, "__at", "row").drop("__at", "end")
