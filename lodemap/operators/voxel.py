"""Voxel grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions.geometry import cell


def _cells(size: float, origin: tuple[float, float, float]) -> list:
    return [cell(a, size, o).alias(f"v{a}") for a, o in zip("xyz", origin, strict=True)]


def downsample(df: DataFrame, size: float, groups: tuple[str, ...] = (), origin: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """A row for each voxel: its mean point and count. One shuffle, with partial sums before it."""
    means = [F.avg(a).alias(a) for a in "xyz"]
    return df.groupBy(*groups, *_cells(size, origin)).agg(*means, F.count("*").alias("n"))


def lower_bound(df: DataFrame) -> tuple[float, float, float]:
    """The least coordinates of a cloud, for grids that begin there."""
    row = df.agg(*(F.min(a).alias(a) for a in "xyz")).first()
    return tuple(row[a] or 0.0 for a in "xyz")


def first_of_voxel(df: DataFrame, size: float, key: str = "point_id", groups: tuple[str, ...] = ()) -> DataFrame:
    """The row of least key in each voxel, with all its columns."""
    row = F.min_by(F.struct(*df.columns), F.col(key)).alias("row")
    return df.groupBy(*groups, *_cells(size, (0, 0, 0))).agg(row).select("row.*")


def quantized(df: DataFrame, size: float, groups: tuple[str, ...]) -> DataFrame:
    """Coordinates in voxels, halves to even, from the least of their group on."""
    steps = df.withColumns({f"q{a}": F.rint(F.col(a) / size).cast("long") for a in "xyz"})
    least = steps.groupBy(*groups).agg(*(F.min(f"q{a}").alias(f"m{a}") for a in "xyz"))
    out = steps.join(least, list(groups))
    return out.withColumns({f"q{a}": F.col(f"q{a}") - F.col(f"m{a}") for a in "xyz"}).drop("mx", "my", "mz")
