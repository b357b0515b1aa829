"""Queries on labels, geometry, filters, voxels, neighbours and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import geometry, labels
from lodemap.functions.geometry import tidy
from lodemap.operators import filters, sets, spatial, trajectory, voxel
from lodemap.sources import fixtures as fx

from .registry import query

R = "round({0}, 6) + 0.0 AS {1}"


def _xyz(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, *(tidy(F.col(a)).alias(a) for a in "xyz"))


XYZ = ", ".join(R.format(a, a) for a in "xyz")


@query(f"""WITH {fx.PACKED} SELECT point_id, packed & 65535 AS sem, packed >> 16 AS inst,
  CASE WHEN packed >> 16 = 0 THEN packed & 65535 ELSE packed >> 16 END AS panoptic FROM packed_labels""")
def label_unpack(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("packed")
    return fx.packed_labels(spark, d).select(
        "point_id", labels.semantic(p).alias("sem"), labels.instance(p).alias("inst"), labels.panoptic(p).alias("panoptic")
    )


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, CAST(l_linenumber AS BIGINT) + (CAST(l_suppkey AS BIGINT) << 16) AS packed,
  (CAST(l_linenumber AS BIGINT) * 1000 + l_suppkey) % 65536 AS thousands, ((CAST(l_linenumber AS BIGINT) * 1000 + l_suppkey) % 65536) % 1000 AS inst
  FROM lineitem""")
def label_pack(spark: SparkSession, d: str) -> DataFrame:
    sem, inst = F.col("l_linenumber"), F.col("l_suppkey")
    thousands = labels.packed_thousands(sem, inst)
    return fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", labels.packed(sem, inst).alias("packed"),
        thousands.alias("thousands"), labels.unpacked_thousands(thousands).alias("inst"),
    )


@query(f"""WITH {fx.PACKED} SELECT point_id, packed >> 16 AS clean, (((packed >> 16) << 16) * (packed & 65545)) % 4294967296 AS odd
  FROM packed_labels""")
def instance_decode(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("packed")
    return fx.packed_labels(spark, d).select("point_id", labels.instance(p).alias("clean"), labels.instance(p, "reference").alias("odd"))


@query("""SELECT c_custkey, coalesce(n_regionkey, -1) AS train, coalesce(r_name, 'none') AS name FROM customer
  LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey""")
def class_remap(spark: SparkSession, d: str) -> DataFrame:
    nation, region = fx.table(spark, d, "nation"), fx.table(spark, d, "region")
    lut = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))  # an ontology: a row for each class
    out = fx.table(spark, d, "customer").join(lut, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", F.coalesce("n_regionkey", F.lit(-1)).alias("train"), F.coalesce("r_name", F.lit("none")).alias("name"))


@query(f"WITH {fx.PACKED} SELECT point_id, packed & 65535 AS sem FROM packed_labels WHERE packed & 65535 < 50")
def moving_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.packed_labels(spark, d).select("point_id", labels.semantic(F.col("packed")).alias("sem"))
    return filters.composed(rows, lambda t: filters.static_only(t, moving_from=50))


@query(f"WITH {fx.POINTS} SELECT point_id, {XYZ} FROM points WHERE sqrt(x * x + y * y + z * z) BETWEEN 0.1 AND 0.25")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    return _xyz(filters.in_range(fx.points(spark, d), 0.1, 0.25), "point_id")


_C, _S = "cos(radians(0.205))", "sin(radians(0.205))"


@query(f"""WITH {fx.POINTS}, r AS (SELECT *, sqrt(x * x + y * y) AS rho FROM points) SELECT point_id,
  {R.format(f"x * ({_C} - {_S} * z / rho)", "x")}, {R.format(f"y * ({_C} - {_S} * z / rho)", "y")}, {R.format(f"z * {_C} + rho * {_S}", "z")} FROM r""")
def calib_correct(spark: SparkSession, d: str) -> DataFrame:
    out = fx.points(spark, d).select("point_id", *(c.alias(a) for a, c in zip("xyz", geometry.calibrated(), strict=True)))
    return _xyz(out, "point_id")


@query(f"""WITH {fx.POINTS}, {fx.POSES} SELECT point_id, {R.format("c * x - s * y + tx", "x")}, {R.format("s * x + c * y", "y")},
  {R.format("z", "z")} FROM points JOIN poses USING (frame)""")
def rigid_transform(spark: SparkSession, d: str) -> DataFrame:
    out = fx.points(spark, d).join(fx.poses(spark, d), "frame")
    return _xyz(out.select("point_id", *(c.alias(a) for a, c in zip("xyz", geometry.transformed("pose"), strict=True))), "point_id")


@query(f"""WITH {fx.POINTS}, {fx.POSES} SELECT point_id, {R.format("c * (x - tx) + s * y", "x")}, {R.format("c * y - s * (x - tx)", "y")},
  {R.format("z", "z")} FROM points JOIN poses USING (frame)""")
def inverse_transform(spark: SparkSession, d: str) -> DataFrame:
    out = fx.points(spark, d).join(fx.poses(spark, d), "frame")
    return _xyz(out.select("point_id", *(c.alias(a) for a, c in zip("xyz", geometry.transformed_back("pose"), strict=True))), "point_id")


@query(f"""WITH {fx.POINTS} SELECT point_id, {", ".join(R.format(f"{a} - avg({a}) OVER (PARTITION BY frame)", a) for a in "xyz")} FROM points""")
def center_chunk(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    means = p.groupBy("frame").agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
    return _xyz(p.join(means, "frame").select("point_id", *((F.col(a) - F.col(f"m{a}")).alias(a) for a in "xyz")), "point_id")


_PIXELS = f"""WITH {fx.POINTS}, pixels AS (SELECT point_id, z, gt, CAST(round_even(x / z * 20.0 + 25.0, 0) AS INTEGER) AS u,
  CAST(round_even(y / z * 20.0 + 10.0, 0) AS INTEGER) AS v FROM points WHERE z > 0),
  seen AS (SELECT * FROM pixels WHERE u BETWEEN 0 AND 49 AND v BETWEEN 0 AND 19)"""


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    u, v = geometry.pixel(F.col("x"), F.col("y"), F.col("z"), 20.0, 25.0, 10.0)
    rows = fx.points(spark, d).where("z > 0").select("point_id", "z", "gt", u.alias("u"), v.alias("v"))
    return rows.where(F.col("u").between(0, 49) & F.col("v").between(0, 19))


@query(_PIXELS + " SELECT point_id, u, v FROM seen")
def project_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).select("point_id", "u", "v")


@query(_PIXELS + " SELECT u, v, arg_min(point_id, (z, point_id)) AS point_id FROM seen GROUP BY u, v")
def zbuffer(spark: SparkSession, d: str) -> DataFrame:
    return _pixels(spark, d).groupBy("u", "v").agg(F.min_by("point_id", F.struct("z", "point_id")).alias("point_id"))


@query(_PIXELS.replace("WITH ", f"WITH {fx.RASTER}, ", 1) + " SELECT point_id, u, v, coalesce(label, -1) AS label FROM seen LEFT JOIN raster USING (u, v)")
def raster_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = _pixels(spark, d).join(fx.raster(spark, d), ["u", "v"], "left")
    return out.select("point_id", "u", "v", F.coalesce("label", F.lit(-1)).alias("label"))


@query(_PIXELS + " SELECT CAST(trunc(u * 0.5) AS INTEGER) AS cu, CAST(trunc(v * 0.5) AS INTEGER) AS cv, count(*) AS n, max(gt) AS painted FROM seen GROUP BY ALL")
def coarse_raster(spark: SparkSession, d: str) -> DataFrame:
    """Masks painted on a coarser raster: the later (larger) one overwrites."""
    cell = [geometry.scaled_index(a, 1, 2).alias(f"c{a}") for a in "uv"]
    return _pixels(spark, d).groupBy(*cell).agg(F.count("*").alias("n"), F.max("gt").alias("painted"))


_V = "CAST(floor({0} / {1}) AS BIGINT) AS v{0}"
_CELLS = ", ".join(_V.format(a, 0.1) for a in "xyz")


@query(f"WITH {fx.POINTS} SELECT {_CELLS}, {', '.join(R.format(f'avg({a})', a) for a in 'xyz')}, count(*) AS n FROM points GROUP BY vx, vy, vz")
def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    return _xyz(voxel.downsample(fx.points(spark, d), 0.1), "vx", "vy", "vz", "n")


@query("""SELECT CAST(floor(l_quantity / 5.0) AS BIGINT) AS vx, CAST(floor(l_discount * 100 / 5.0) AS BIGINT) AS vy, CAST(floor(l_tax * 100 / 5.0) AS BIGINT)
  AS vz, round(avg(l_quantity), 6) + 0.0 AS x, round(avg(l_discount * 100), 6) + 0.0 AS y, round(avg(l_tax * 100), 6) + 0.0 AS z, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3""")
def voxel_volume(spark: SparkSession, d: str) -> DataFrame:
    """Voxels over the table with the most rows."""
    scan = fx.table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z")
    )
    return _xyz(voxel.downsample(scan, 5.0), "vx", "vy", "vz", "n")


@query(f"WITH {fx.POINTS} SELECT min(point_id) AS point_id FROM points GROUP BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1)")
def voxel_first(spark: SparkSession, d: str) -> DataFrame:
    return voxel.first_of_voxel(fx.points(spark, d), 0.1).select("point_id")


_Q = ", ".join(f"CAST(round_even({a} / 0.05, 0) AS BIGINT) - min(CAST(round_even({a} / 0.05, 0) AS BIGINT)) OVER (PARTITION BY frame) AS q{a}" for a in "xyz")


@query(f"WITH {fx.POINTS} SELECT point_id, {_Q} FROM points")
def voxel_quantize(spark: SparkSession, d: str) -> DataFrame:
    return voxel.quantized(fx.points(spark, d), 0.05, ("frame",)).select("point_id", "qx", "qy", "qz")


@query(f"WITH {fx.POINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY point_id) AS k FROM points) SELECT point_id FROM n WHERE (k - 1) % 3 = 0")
def every_kth(spark: SparkSession, d: str) -> DataFrame:
    return filters.every_kth(fx.points(spark, d), 3, "point_id", ("frame",)).select("point_id")


@query(f"WITH {fx.POINTS} SELECT point_id FROM points p WHERE abs(x * cos(0.3) + y * sin(0.3)) <= 0.15 AND abs(y * cos(0.3) - x * sin(0.3)) <= 0.1 AND abs(z) <= 0.1")
def obb_crop(spark: SparkSession, d: str) -> DataFrame:
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 0.3, 0.3, 0.2, 0.2)], "cx double, cy double, cz double, yaw double, ex double, ey double, ez double")
    return filters.in_oriented_box(fx.points(spark, d), box).select("point_id")


@query(f"WITH {fx.POINTS} SELECT frame, point_id FROM points WHERE x > -0.1 AND x < 0.1 AND y > -0.1 AND y < 0.1 AND z > -0.2 AND z < 0.2")
def chunk_crop(spark: SparkSession, d: str) -> DataFrame:
    low, high = ({a: F.lit(s * v) for a, v in zip("xyz", (0.1, 0.1, 0.2), strict=True)} for s in (-1, 1))
    return filters.in_box(fx.points(spark, d), low, high).select("frame", "point_id")


@query(f"""WITH {fx.POINTS} SELECT point_id FROM (SELECT *, avg(z) OVER (PARTITION BY frame) AS m FROM points) WHERE z < m + 0.05""")
def ground_cut(spark: SparkSession, d: str) -> DataFrame:
    return filters.below_ground_margin(fx.points(spark, d), ("frame",), 0.05).select("point_id")


# --- neighbours --------------------------------------------------------------------------------------------------------

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_HALVES = f"""WITH {fx.POINTS}, a AS (SELECT * FROM points WHERE point_id % 2 = 0), b AS (SELECT * FROM points WHERE point_id % 2 = 1),
  near AS (SELECT a.point_id, b.point_id AS other, b.gt, b.feat, {_D2} AS d2 FROM a, b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, other) AS k FROM near)"""


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = fx.points(spark, d)
    return p.where("point_id % 2 = 0"), p.where("point_id % 2 = 1")


@query(_HALVES + " SELECT point_id, gt FROM ranked WHERE k = 1")
def knn1_transfer(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return spatial.nearest_value(a.select("point_id", *"xyz"), b, "gt", 0.1).select("point_id", "gt")


@query(_HALVES + " SELECT point_id, CASE WHEN d2 <= 0.0025 THEN gt ELSE -1 END AS gt FROM ranked WHERE k = 1")
def knn1_capped(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return spatial.nearest_value(a.select("point_id", *"xyz"), b, "gt", 0.05, 0.05, -1).select("point_id", "gt")


@query(_HALVES + " SELECT point_id, round(sum(gt / (d2 + 1e-8)) / sum(1 / (d2 + 1e-8)), 6) + 0.0 AS gt FROM ranked WHERE k <= 3 GROUP BY point_id")
def knn3_interp(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    return spatial.interpolated(a, b, "gt", 3, 0.1).select("point_id", tidy(F.col("gt")).alias("gt"))


@query(_HALVES + " SELECT point_id FROM a WHERE point_id IN (SELECT point_id FROM near WHERE d2 < 0.04 * 0.04)")
def near_semi(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_any(*_halves(spark, d), 0.04).select("point_id")


@query(_HALVES + " SELECT point_id FROM a WHERE point_id NOT IN (SELECT point_id FROM near WHERE d2 < 0.04 * 0.04)")
def near_dup_anti(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_any(*_halves(spark, d), 0.04, anti=True).select("point_id")


@query(_HALVES + """, m AS (SELECT point_id, avg(feat[1]) AS f0, avg(feat[2]) AS f1 FROM near WHERE d2 <= 0.1 * 0.1 GROUP BY point_id)
  SELECT a.point_id, round(coalesce(f0, 0), 6) + 0.0 AS f0, round(coalesce(f1, 0), 6) + 0.0 AS f1 FROM a LEFT JOIN m USING (point_id)""")
def radius_mean_feature(spark: SparkSession, d: str) -> DataFrame:
    a, b = _halves(spark, d)
    out = spatial.mean_feature(a, b, "feat", 0.1, 2)
    return out.select("point_id", *(tidy(F.col("mean_feature")[i]).alias(f"f{i}") for i in range(2)))


_SELF = f"""WITH {fx.POINTS}, near AS (SELECT a.point_id, b.point_id AS other, {_D2} AS d2 FROM points a, points b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, other) AS k FROM near)"""


@query(_SELF + """, own AS (SELECT point_id, avg(sqrt(d2)) AS m FROM ranked WHERE k <= 20 GROUP BY point_id)
  SELECT point_id FROM own WHERE m < (SELECT avg(m) + 2 * stddev_samp(m) FROM own)""")
def stat_outlier(spark: SparkSession, d: str) -> DataFrame:
    return spatial.statistical_inliers(fx.points(spark, d), 20, 2.0, 0.1).select("point_id")


@query(f"""WITH {fx.POINTS}, near AS (SELECT a.point_id, a.z AS z, b.z AS bz, row_number() OVER (PARTITION BY a.point_id
  ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.point_id) AS k FROM points a, points b),
  own AS (SELECT point_id, any_value(z) AS z, min(bz) AS lo, max(bz) AS hi FROM near WHERE k <= 8 GROUP BY point_id),
  scored AS (SELECT point_id, exp(-coalesce(((z - lo) / nullif(hi - lo, 0)) * ((z - lo) / nullif(hi - lo, 0)), 0)) AS score FROM own)
  SELECT point_id, round(score, 6) + 0.0 AS score, score > (SELECT avg(score) FROM scored) AS visible FROM scored""")
def depth_visibility(spark: SparkSession, d: str) -> DataFrame:
    return spatial.depth_visible(fx.points(spark, d), 8, 0.1).select("point_id", tidy(F.col("score")).alias("score"), "visible")


# --- trajectories ------------------------------------------------------------------------------------------------------

_WAY = f"""WITH RECURSIVE {fx.TRAJECTORY}, steps AS (SELECT seq, frame, px, py, coalesce(sqrt((px - lag(px) OVER w) * (px - lag(px) OVER w)
  + (py - lag(py) OVER w) * (py - lag(py) OVER w)), 0) AS step FROM trajectory WINDOW w AS (PARTITION BY seq ORDER BY frame))"""


@query(_WAY + " SELECT seq, frame, round(sum(step) OVER (PARTITION BY seq ORDER BY frame), 4) + 0.0 AS way FROM steps")
def odometer(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.odometer(fx.trajectory(spark, d)).select("seq", "frame", tidy(F.col("way"), 4).alias("way"))


@query(_WAY + """, fold AS (SELECT seq, frame, CAST(0 AS DOUBLE) AS way, false AS cut FROM steps WHERE frame = 0 UNION ALL
  SELECT s.seq, s.frame, CASE WHEN f.way + s.step > 150 THEN 0 ELSE f.way + s.step END, f.way + s.step > 150
  FROM fold f JOIN steps s ON s.seq = f.seq AND s.frame = f.frame + 1) SELECT seq, frame FROM fold WHERE cut""")
def odometer_chunks(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.odometer_chunks(fx.trajectory(spark, d), 150.0)


@query(f"""WITH {fx.TRAJECTORY} SELECT seq, frame, count(*) OVER w AS n, min(frame) OVER w AS first, max(frame) OVER w AS last FROM trajectory
  WINDOW w AS (PARTITION BY seq ORDER BY frame ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)""")
def frame_window(spark: SparkSession, d: str) -> DataFrame:
    out = trajectory.frame_window(fx.trajectory(spark, d), 10, 10)
    return out.select("seq", "frame", F.size("frames").cast("long").alias("n"), F.array_min("frames").alias("first"), F.array_max("frames").alias("last"))


@query(f"""WITH {fx.TRAJECTORY}, m AS (SELECT *, frame // 20 AS map_id, count(*) OVER (PARTITION BY seq, frame // 20) AS n FROM trajectory)
  SELECT seq, frame, CAST(map_id AS BIGINT) AS map_id FROM m WHERE n >= 15""")
def map_partition(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.map_parts(fx.trajectory(spark, d), 20, 15).select("seq", "frame", "map_id")


@query(f"""WITH {fx.TRAJECTORY}, o AS (SELECT *, px - min(px) OVER (PARTITION BY seq) AS ox, py - min(py) OVER (PARTITION BY seq) AS oy FROM trajectory),
  n AS (SELECT *, round_even(ox / 40, 0) AS nx, round_even(oy / 40, 0) AS ny FROM o),
  k AS (SELECT seq, frame, nx, ny, (ox - nx * 40) * (ox - nx * 40) + (oy - ny * 40) * (oy - ny * 40) AS d2 FROM n
    WHERE abs(ox - nx * 40) < 20 AND abs(oy - ny * 40) < 20)
  SELECT seq, arg_min(frame, (round(d2, 9), frame)) AS frame FROM k GROUP BY seq, nx, ny""")
def pose_subsample(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.pose_subsample(fx.trajectory(spark, d), 40.0)


@query(f"""WITH {fx.TRAJECTORY} SELECT c.seq, c.frame AS chunk, p.frame FROM trajectory c JOIN trajectory p ON c.seq = p.seq
  WHERE c.frame % 10 = 0 AND (p.px - c.px) * (p.px - c.px) + (p.py - c.py) * (p.py - c.py) < 900""")
def chunk_frames(spark: SparkSession, d: str) -> DataFrame:
    t = fx.trajectory(spark, d)
    return trajectory.chunk_frames(t.where("frame % 10 = 0"), t, 30.0)


# --- sets --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.POINTS}, u AS (SELECT 0 AS part, * FROM points WHERE point_id % 3 < 2 UNION ALL SELECT 1, * FROM points WHERE point_id % 3 > 0)
  SELECT part, point_id FROM (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY part, point_id) AS k FROM u) WHERE k = 1""")
def dedup_union(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return sets.united([p.where("point_id % 3 < 2"), p.where("point_id % 3 > 0")]).select("part", "point_id")


@query(f"""WITH {fx.POINTS}, a AS (SELECT point_id FROM points WHERE point_id % 2 = 0), b AS (SELECT point_id FROM points WHERE point_id % 3 = 0)
  SELECT 'both' AS part, point_id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', point_id FROM (FROM a UNION FROM b)
  UNION ALL SELECT 'first', point_id FROM (FROM a EXCEPT FROM b)""")
def index_sets(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).select("point_id")
    return sets.index_sets(p.where("point_id % 2 = 0"), p.where("point_id % 3 = 0"))


@query(f"WITH {fx.PREDICTED} SELECT point_id, CAST(dense_rank() OVER (ORDER BY pred) - 1 AS BIGINT) AS dense FROM predicted")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return sets.dense_ids(fx.predicted(spark, d), "pred", "dense").select("point_id", "dense")


@query(f"WITH {fx.POINTS} SELECT frame, list(point_id ORDER BY point_id)::VARCHAR AS ids FROM points GROUP BY frame")
def collate(spark: SparkSession, d: str) -> DataFrame:
    out = sets.collated(fx.points(spark, d), ("frame",), ["point_id"], "point_id")
    return out.select("frame", F.concat(F.lit("["), F.concat_ws(", ", F.transform("point_id", lambda v: v.cast("string"))), F.lit("]")).alias("ids"))
