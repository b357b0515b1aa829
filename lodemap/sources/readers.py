"""Readers of scan, label, pose, calibration and feature files as DataFrames; files are read by Spark wherever they lie."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    frame = F.regexp_extract("path", r"([0-9]+)\.[A-Za-z0-9.]+$", 1).cast("int")
    return files.select(frame.alias("frame"), "content")


def scans(spark: SparkSession, path: str, values: int = 4, pattern: str = "*.bin") -> DataFrame:
    """frame, point_id, x, y, z, intensity of little-endian float32 scans of ``values`` numbers a point (4, or 5 with a ring,
    which is dropped). A truncated last point is ignored; an empty file has no points."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for frame, content in zip(part["frame"], part["content"], strict=True):
                flat = np.frombuffer(content, "<f4")
                rows = flat[: len(flat) // values * values].reshape(-1, values)
                out = {"frame": np.int32(frame), "point_id": np.arange(len(rows))} | {c: rows[:, i] for i, c in enumerate(("x", "y", "z", "intensity"))}
                yield pd.DataFrame(out)

    return _files(spark, path, pattern).mapInPandas(parse, "frame int, point_id long, x float, y float, z float, intensity float")


def packed_labels(spark: SparkSession, path: str, kind: str = "<u4", pattern: str = "*.label") -> DataFrame:
    """frame, point_id, packed of label files (``<u4``, or ``<u2`` for class times 1000 plus instance)."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for frame, content in zip(part["frame"], part["content"], strict=True):
                values = np.frombuffer(content, kind).astype(np.int64)
                yield pd.DataFrame({"frame": np.int32(frame), "point_id": np.arange(len(values)), "packed": values})

    return _files(spark, path, pattern).mapInPandas(parse, "frame int, point_id long, packed long")


def point_features(spark: SparkSession, path: str, size: int = 96, pattern: str = "*.bin") -> DataFrame:
    """frame, point_id, feat of zlib-compressed float32 features of ``size`` numbers a point."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for frame, content in zip(part["frame"], part["content"], strict=True):
                rows = np.frombuffer(zlib.decompress(content), "<f4").reshape(-1, size)
                yield pd.DataFrame({"frame": np.int32(frame), "point_id": np.arange(len(rows)), "feat": list(rows)})

    return _files(spark, path, pattern).mapInPandas(parse, "frame int, point_id long, feat array<float>")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """frame and a 4×4 of text files with twelve numbers a line; the line's number is the frame. A sequence's poses are one
    short file, read as one row so that line numbers are certain."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("frame", "line"))
    m = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double"))
    return lines.where("trim(line) <> ''").select("frame", F.concat(m, F.array(*(F.lit(float(v)) for v in (0, 0, 0, 1)))).alias("pose"))


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """key and a 4×4 of lines ``key: twelve numbers``."""
    lines = spark.read.text(path).where(F.col("value").contains(":"))
    part = F.split("value", ":", 2)
    m = F.transform(F.split(F.trim(part[1]), r"\s+"), lambda v: v.cast("double"))
    return lines.select(F.trim(part[0]).alias("key"), F.concat(m, F.array(*(F.lit(float(v)) for v in (0, 0, 0, 1)))).alias("m"))


def _product(a: F.Column, b: F.Column) -> F.Column:
    return F.array(*(sum((a[4 * r + k] * b[4 * k + c] for k in range(4)), F.lit(0.0)) for r in range(4) for c in range(4)))


def _inverse(m: F.Column) -> F.Column:
    rows = []
    for r in range(3):
        rows += [m[r], m[4 + r], m[8 + r], -(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11])]
    return F.array(*rows, *(F.lit(float(v)) for v in (0, 0, 0, 1)))


def sensor_poses(pose_rows: DataFrame, calib: DataFrame, key: str = "Tr") -> DataFrame:
    """Poses of the scanner from those of the camera: the inverse of the calibration, the pose, the calibration."""
    tr = calib.where(F.col("key") == key).select(F.col("m").alias("tr")).limit(1)
    both = pose_rows.crossJoin(F.broadcast(tr))  # one row
    return both.select("frame", _product(_product(_inverse(F.col("tr")), F.col("pose")), F.col("tr")).alias("pose"))


def ontology(spark: SparkSession, classes: dict[int, int], names: dict[int, str], ignore: set[int] = frozenset()) -> DataFrame:
    """raw, train, name and ignore, a row for each raw class."""
    rows = [(raw, train, names.get(raw), train in ignore) for raw, train in sorted(classes.items())]
    return spark.createDataFrame(rows, "raw int, train int, name string, ignore boolean")


def pending(inputs: DataFrame, outputs: DataFrame, key: str = "frame") -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def pseudo_chunks(spark: SparkSession, path: str, chunk: str = "chunk_id") -> DataFrame:
    """Training chunks with centred coordinates, an intensity of 1 and class 0."""
    rows = spark.read.parquet(path)
    means = rows.groupBy(chunk).agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    centred = rows.join(means, chunk).withColumns({a: F.col(a) - F.col(f"m{a}") for a in "xyz"}).drop("mx", "my", "mz")
    return centred.withColumns({"intensity": F.lit(1.0), "sem": F.lit(0)})


def chained_poses(ego: DataFrame, sensor: DataFrame) -> DataFrame:
    """frame and the pose of a sensor in the world: the vehicle's pose (frame, pose) times the sensor's in the vehicle (one row,
    pose)."""
    mount = sensor.select(F.col("pose").alias("mount")).limit(1)
    return ego.crossJoin(F.broadcast(mount)).select("frame", _product(F.col("pose"), F.col("mount")).alias("pose"))  # one row


def cameras(calib: DataFrame, scanner: str = "Tr") -> DataFrame:
    """camera, focal lengths (fu, fv), centre (cu, cv) and the matrix from the scanner to the image plane of calibration rows
    ``P<number>``; a row for each camera."""
    tr = calib.where(F.col("key") == scanner).select(F.col("m").alias("tr")).limit(1)
    m = F.col("m")
    rows = calib.where(F.col("key").rlike("^P[0-9]+$")).crossJoin(F.broadcast(tr))  # one row
    return rows.select(
        F.col("key").alias("camera"), m[0].alias("fu"), m[5].alias("fv"), m[2].alias("cu"), m[6].alias("cv"), _product(m, F.col("tr")).alias("from_scanner")
    )


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """camera (the file's folder), frame and content of image files; a left join by camera and frame leaves null where there is
    none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parts = F.regexp_extract("path", r"([^/]+)/([0-9]+)\.[A-Za-z0-9]+$", 1), F.regexp_extract("path", r"([^/]+)/([0-9]+)\.[A-Za-z0-9]+$", 2).cast("int")
    return found.select(parts[0].alias("camera"), parts[1].alias("frame"), "content")


def world_scans(spark: SparkSession, path: str) -> DataFrame:
    """frame, point_id, x, y, z of tables whose points are in the world frame already: Parquet files partitioned by frame, with
    other columns (intensity, time, sensor) that are left out."""
    return spark.read.parquet(path).select(F.col("frame").cast("int").alias("frame"), "point_id", *"xyz")
