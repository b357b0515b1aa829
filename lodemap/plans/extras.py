"""Queries on encodings, normals, quaternions, samples and mask statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import geometry
from lodemap.functions.geometry import tidy
from lodemap.operators import filters, sampling, sets
from lodemap.sources import fixtures as fx

from .registry import query

_BANDS = [48.0 ** (i / 3) for i in range(4)]


@query(f"""WITH {fx.POINTS} SELECT point_id, {", ".join(f"round(sin(x * {b!r} * pi()), 6) + 0.0 AS s{i}, round(cos(x * {b!r} * pi()), 6) + 0.0 AS c{i}" for i, b in enumerate(_BANDS))} FROM points""")
def fourier_encoding(spark: SparkSession, d: str) -> DataFrame:
    code = fx.points(spark, d).select("point_id", geometry.fourier("x", 48.0, 4).alias("code"))
    parts = [tidy(F.col("code")[i]).alias(f"s{i}") for i in range(4)] + [tidy(F.col("code")[4 + i]).alias(f"c{i}") for i in range(4)]
    return code.select("point_id", *parts)


_ANGLE = "acos(greatest(-1, least(1, z / (sqrt(x * x + y * y + z * z) + 1e-6) * (1 / (1 + 1e-6)))))"


@query(f"WITH {fx.POINTS} SELECT point_id, round({_ANGLE}, 6) + 0.0 AS angle, {_ANGLE} <= radians(40) AND z > 0 AS upward FROM points")
def normal_angle(spark: SparkSession, d: str) -> DataFrame:
    v = [F.col(a) for a in "xyz"]
    up = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return fx.points(spark, d).select("point_id", tidy(geometry.angle(v, up)).alias("angle"), geometry.upward(v, 40.0).alias("upward"))


@query(f"""WITH {fx.POINTS} SELECT point_id, round(x * cos(0.2 * frame) - y * sin(0.2 * frame) + 1, 6) + 0.0 AS x,
  round(x * sin(0.2 * frame) + y * cos(0.2 * frame) + 2, 6) + 0.0 AS y, round(z + 3, 6) + 0.0 AS z FROM points""")
def quaternion_pose(spark: SparkSession, d: str) -> DataFrame:
    """A turn about z by a unit quaternion, composed with a translation."""
    half = F.col("frame") * 0.1
    rotation = geometry.quaternion_rotation(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    posed = fx.points(spark, d).withColumn("pose", geometry.matrix(rotation, [F.lit(float(v)) for v in (1, 2, 3)]))
    moved = geometry.transformed("pose")
    return posed.select("point_id", *(tidy(c).alias(a) for a, c in zip("xyz", moved, strict=True)))


@query(f"""WITH {fx.PREDICTED}, m AS (SELECT frame, pred, count(*) AS n FROM predicted GROUP BY ALL), f AS (SELECT frame, count(*) AS masks, count(*) FILTER (n >= 2) AS large FROM m GROUP BY frame)
  SELECT max(masks) AS most_masks, sum(large)::BIGINT AS large_masks FROM f""")
def mask_statistics(spark: SparkSession, d: str) -> DataFrame:
    sizes = fx.predicted(spark, d).groupBy("frame", "pred").agg(F.count("*").alias("n"))
    frames = sizes.groupBy("frame").agg(F.count("*").alias("masks"), F.count(F.when(F.col("n") >= 2, 1)).alias("large"))
    return frames.agg(F.max("masks").alias("most_masks"), F.sum("large").alias("large_masks"))


@query(f"""WITH {fx.PREDICTED} SELECT point_id, pred FROM predicted WHERE gt NOT IN (0, 3) AND pred IN (SELECT pred FROM predicted GROUP BY pred HAVING count(*) > 3)""")
def ignored_and_small(spark: SparkSession, d: str) -> DataFrame:
    """Ignored true classes are left out, then masks that were too small from the start."""
    rows = fx.predicted(spark, d)
    large = rows.groupBy("pred").count().where("count > 3").select("pred")
    return rows.where(~F.col("gt").isin(0, 3)).join(large, "pred", "left_semi").select("point_id", "pred")


@query(f"""WITH {fx.POINTS} SELECT point_id FROM points WHERE NOT (abs(x * cos(0.3) + y * sin(0.3)) <= 0.15 AND abs(y * cos(0.3) - x * sin(0.3)) <= 0.1 AND abs(z) <= 0.1)""")
def moving_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Points outside the boxes of moving objects."""
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 0.3, 0.3, 0.2, 0.2)], "cx double, cy double, cz double, yaw double, ex double, ey double, ez double")
    return filters.in_oriented_box(fx.points(spark, d), box, anti=True).select("point_id")


@query(f"WITH {fx.RASTER}, m AS (SELECT label, count(*) AS area FROM raster GROUP BY label) SELECT label, area, row_number() OVER (ORDER BY area DESC, label) AS place FROM m")
def masks_by_area(spark: SparkSession, d: str) -> DataFrame:
    areas = fx.raster(spark, d).groupBy("label").agg(F.count("*").alias("area"))
    ranked = areas.withColumn("order", F.struct((-F.col("area")).alias("area"), "label"))
    return sets.dense_ids(ranked, "order", "place").select("label", "area", (F.col("place") + 1).cast("long").alias("place"))


@query()
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five points of each frame, then forty of these; seeded, so tests can ask for the same ones again."""
    return sampling.sampled(sampling.sampled_per_group(fx.points(spark, d), 5, 1, "frame"), 40, 2).select("point_id")


@query()
def augmentation(spark: SparkSession, d: str) -> DataFrame:
    """Seeded; tests hold it against the distances it must keep."""
    return sampling.augmented(fx.points(spark, d), "frame", 3).select("point_id", "frame", *"xyz")


@query()
def ground_planes(spark: SparkSession, d: str) -> DataFrame:
    """Seeded draws; tests hold it against a plane that is there."""
    return sampling.ground_planes(fx.points(spark, d), "frame", 0.05)


