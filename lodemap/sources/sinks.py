"""Writers: partitioned tables, packed predictions, metric and confidence reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import labels


def write_cloud(df: DataFrame, path: str, by: tuple[str, ...] = ("map_id", "chunk_id"), mode: str = "errorifexists") -> None:
    """Points partitioned by map and chunk, so that a reader of one chunk lists one folder."""
    df.repartition(*by).write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def checkpointed(df: DataFrame, path: str) -> DataFrame:
    """``df`` as the table at ``path``, written only if there is none yet."""
    df.write.mode("ignore").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_predictions(df: DataFrame, path: str, thousands: bool = False) -> None:
    """frame, point_id and the packed label of sem and inst."""
    pack = labels.packed_thousands if thousands else labels.packed
    df.select("frame", "point_id", pack(F.col("sem"), F.col("inst")).alias("packed")).write.partitionBy("frame").parquet(path)


def write_training_chunks(points: DataFrame, ncut: DataFrame, path: str, by: tuple[str, ...] = ("seq", "chunk")) -> None:
    """Points with their pseudo-labels, joined by id so that columns can't drift apart."""
    points.join(ncut, [*by, "point_id"]).write.partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A JSON line for each row: metrics of a sequence, confidences of labels."""
    df.write.json(path)


def averaged_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The mean of every numeric field over reports."""
    rows = spark.read.json(paths)
    numeric = [c for c, t in rows.dtypes if t in ("double", "bigint")]
    return rows.agg(*(F.avg(c).alias(c) for c in numeric))
