"""Point-map tables derived from the driver's tables, each as a DataFrame and as the SQL of the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, frame, x, y, z, feat, gt."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        (F.col("vec_id") % 10).cast("int").alias("frame"),
        *(e[i].cast("double").alias(n) for i, n in enumerate("xyz")),
        F.transform(F.slice(e, 4, 8), lambda v: v.cast("double")).alias("feat"),
        F.col("label").cast("long").alias("gt"),
    )


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with ``pred``, the number of a horizontal cell."""
    side = lambda a: F.floor(F.col(a) / 0.15).cast("long") + 10
    return points(spark, sf_dir).withColumn("pred", side("x") * 100 + side("y"))


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, frame, px, py: the events of a user in order of time."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq"),
        (F.row_number().over(order) - 1).cast("int").alias("frame"),
        F.col("value").alias("px"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("py"),
    )


def packed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), (F.col("user_id") * 65536 + k).alias("packed"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame and a 4×4 pose: a turn of 0.1 radian a frame and a metre a frame along x. The SQL's 0.1 is a decimal, so three
    frames are 0.3 radian, which 3 * 0.1 in doubles is not."""
    from lodemap.functions.geometry import matrix

    f = points(spark, sf_dir).select("frame").distinct()
    c, s = F.cos(F.col("frame") / 10), F.sin(F.col("frame") / 10)
    zero, one = F.lit(0.0), F.lit(1.0)
    return f.select("frame", matrix([c, -s, zero, s, c, zero, zero, zero, one], [F.col("frame").cast("double"), zero, zero]).alias("pose"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 50).cast("int").alias("u"), F.expr("cast(p_partkey div 50 as int)").alias("v"), F.col("p_size").alias("label")
    )


def mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, query, logit for ten queries."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), "label", F.posexplode(F.slice("embedding", 1, 10)).alias("query", "e")).select(
        "point_id", "label", "query", (F.col("e").cast("double") * 5.0).alias("logit")
    )


#: The same tables for the oracle, as common table expressions.
POINTS = """points AS (SELECT vec_id AS point_id, CAST(vec_id % 10 AS INTEGER) AS frame, CAST(embedding[1] AS DOUBLE) AS x,
  CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4:11] AS DOUBLE[]) AS feat,
  CAST(label AS BIGINT) AS gt FROM embeddings)"""
PREDICTED = f"""{POINTS}, predicted AS (SELECT *, (CAST(floor(x / 0.15) AS BIGINT) + 10) * 100 + CAST(floor(y / 0.15) AS BIGINT) + 10
  AS pred FROM points)"""
TRAJECTORY = """trajectory AS (SELECT user_id AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER)
  AS frame, value AS px, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS py FROM events)"""
PACKED = """packed_labels AS (SELECT event_id AS point_id, user_id * 65536 + CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)
  AS packed FROM events)"""
POSES = """poses AS (SELECT frame, cos(0.1 * frame) AS c, sin(0.1 * frame) AS s, CAST(frame AS DOUBLE) AS tx
  FROM (SELECT DISTINCT frame FROM points))"""
RASTER = """raster AS (SELECT CAST(p_partkey % 50 AS INTEGER) AS u, CAST(p_partkey // 50 AS INTEGER) AS v, p_size AS label FROM part)"""
SCORES = """scores AS (SELECT vec_id AS point_id, label, CAST(q AS INTEGER) AS query, 5.0::DOUBLE * CAST(embedding[q + 1] AS DOUBLE) AS logit
  FROM embeddings, range(10) r(q))"""
