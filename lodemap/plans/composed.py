"""Queries on stages made of several operators, on rasters, and on files that are written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import affinity
from lodemap.functions import labels as lb
from lodemap.functions.geometry import tidy
from lodemap.functions.geometry import matrix, quaternion_rotation
from lodemap.operators import graph, images, maps, metrics, sequences
from lodemap.operators.sets import dense_ids
from lodemap.operators.stages import cut
from lodemap.sources import files, readers, sinks
from lodemap.sources import fixtures as fx

from .instances import _TABLE, _instances
from .registry import query


def _tidy(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in columns})


# --- affinities with cameras -------------------------------------------------------------------------------------------

_VIEWS = {"sam2": ("gt % 3 - 1", "point_id % 4 - 1", "frame % 2"), "sam3": ("gt % 2 - 1", "point_id % 3 - 1")}
_SEEN = f"""{fx.POINTS}, seen AS (SELECT *, {", ".join(f"[{', '.join(v)}] AS {k}" for k, v in _VIEWS.items())},
  CASE WHEN point_id % 5 = 0 THEN feat ELSE list_transform(feat, lambda v: 0.0::DOUBLE) END AS v1, feat[3:8] || feat[1:2] AS v2 FROM points),
  mean AS (SELECT *, CASE WHEN point_id % 5 = 0 THEN list_transform(list_zip(v1, v2), lambda t: (t[1] + t[2]) / 2) ELSE v2 END AS dino FROM seen)"""


def _seen(spark: SparkSession, d: str) -> DataFrame:
    """Points with labels of two cameras' views, and the mean of image features of two views, the first often blank."""
    p = fx.points(spark, d)
    p = p.withColumns({k: F.array(*(F.expr(f"cast({e} as int)") for e in v)) for k, v in _VIEWS.items()})
    first = F.when(F.col("point_id") % 5 == 0, F.col("feat")).otherwise(F.transform("feat", lambda v: F.lit(0.0)))
    second = F.concat(F.slice("feat", 3, 6), F.slice("feat", 1, 2))
    return p.withColumn("dino", affinity.mean_of_views(F.array(first, second), 8))


@query(f"WITH {_SEEN} SELECT point_id, list_transform(dino, lambda v: round(v, 6) + 0.0) AS dino FROM mean")
def view_mean_feature(spark: SparkSession, d: str) -> DataFrame:
    return _seen(spark, d).select("point_id", F.transform("dino", lambda v: tidy(v)).alias("dino"))


def _share(c: str) -> str:
    both = f"list_filter(list_zip(a.{c}, b.{c}), lambda t: t[1] <> -1 AND t[2] <> -1)"
    return f"CASE WHEN len({both}) > 0 THEN len(list_filter({both}, lambda t: t[1] <> t[2])) / len({both}) ELSE 0 END"


@query(f"""WITH {_SEEN}, e AS (SELECT a.frame, a.point_id AS i, b.point_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
    + (a.z - b.z) * (a.z - b.z)) AS d, {_share("sam2")} AS s2, {_share("sam3")} AS s3, list_distance(a.dino, b.dino) AS dino,
    CASE WHEN len(list_filter(a.feat, lambda v: v <> 0)) > 0 AND len(list_filter(b.feat, lambda v: v <> 0)) > 0 THEN list_distance(a.feat, b.feat) ELSE 0 END AS f
    FROM mean a JOIN mean b ON a.frame = b.frame AND a.point_id < b.point_id)
  SELECT frame, i, j, round(exp(-1.0 * d) * exp(-0.3 * s2) * exp(-0.3 * s3) * exp(-0.1 * dino) * exp(-0.5 * f), 6) + 0.0 AS w FROM e WHERE d <= 0.15""")
def camera_affinity(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.camera_affinity(_seen(spark, d), 1.0, 0.3, 0.1, 0.5, ("sam2", "sam3"), ("dino",), "feat", 0.15, chunk=("frame",))
    return _tidy(edges, "w")


# --- maps --------------------------------------------------------------------------------------------------------------

_MAP = f"""{fx.POINTS}, {fx.POSES}, moved AS (SELECT point_id, point_id % 4 = 0 AS is_ground, gt AS inst, gt % 3 AS sem,
    c * x - s * y + tx AS x, s * x + c * y AS y, z FROM points JOIN poses USING (frame))"""


def _map(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d).select("point_id", "frame", *"xyz", (F.col("point_id") % 4 == 0).alias("is_ground"), F.col("gt").alias("inst"))
    return maps.aggregated(p.withColumn("sem", F.col("inst") % 3), fx.poses(spark, d))


@query(f"WITH {_MAP} SELECT point_id, is_ground, inst, sem, {', '.join(f'round({a}, 6) + 0.0 AS {a}' for a in 'xyz')} FROM moved")
def aggregated_map(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(_map(spark, d).drop("frame"), *"xyz")


@query(f"""WITH {_MAP}, minor AS (SELECT is_ground, floor(x / 0.4)::BIGINT AS vx, floor(y / 0.4)::BIGINT AS vy, floor(z / 0.4)::BIGINT AS vz,
    avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM moved GROUP BY ALL),
  near AS (SELECT m.*, p.inst, p.sem, row_number() OVER (PARTITION BY m.is_ground, vx, vy, vz ORDER BY (m.x - p.x) * (m.x - p.x)
    + (m.y - p.y) * (m.y - p.y) + (m.z - p.z) * (m.z - p.z), p.point_id) AS k FROM minor m JOIN moved p ON m.is_ground = p.is_ground)
  SELECT is_ground, vx, vy, vz, n, inst, sem FROM near WHERE k = 1""")
def thinned_map(spark: SparkSession, d: str) -> DataFrame:
    """Both points of a voxel of two are at one distance from its mean but for rounding, so poses and sums round as in the SQL."""
    found = maps.thinned(cut(_map(spark, d)), 0.4, ("inst", "sem"))
    return found.select("is_ground", "vx", "vy", "vz", "n", "inst", "sem")


@query(f"""WITH {fx.POINTS}, every AS (SELECT frame, 0 AS e, point_id FROM points UNION ALL SELECT DISTINCT frame, 1, NULL FROM points)
  SELECT frame, point_id, row_number() OVER (ORDER BY frame, e, point_id) - 1 AS row FROM every""")
def delimited_frames(spark: SparkSession, d: str) -> DataFrame:
    return maps.with_delimiters(fx.points(spark, d).select("frame", "point_id", *"xyz")).select("frame", "point_id", "row")


# --- rasters and colours -----------------------------------------------------------------------------------------------


@query(f"""WITH {fx.POINTS}, c AS (SELECT DISTINCT gt - 1 AS label, ((gt - 1) * {images.SPREAD}) % 16777216 AS code FROM points)
  SELECT label, CASE WHEN label > 0 THEN [(code // 65536)::INT, ((code // 256) % 256)::INT, (code % 256)::INT] ELSE [0, 0, 0] END AS rgb,
  greatest(label, 0) AS back FROM c""")
def label_colours(spark: SparkSession, d: str) -> DataFrame:
    labels = fx.points(spark, d).select((F.col("gt") - 1).alias("label")).distinct().withColumn("rgb", images.colour("label"))
    return labels.withColumn("back", images.label_of("rgb"))


@query(f"""WITH {fx.RASTER}, size AS (SELECT max(v) + 1 AS h FROM raster), grid AS (SELECT u.range::INT AS u, v.range::INT AS v FROM range(20) u, range(30) v)
  SELECT grid.u, grid.v, label FROM grid, size JOIN raster ON raster.u = floor(grid.u * 50 / 20) AND raster.v = floor(grid.v * h / 30)""")
def raster_resized(spark: SparkSession, d: str) -> DataFrame:
    raster = fx.raster(spark, d)
    height = raster.agg(F.max("v") + 1).first()[0] or 1
    return images.resized(raster, 50, height, 20, 30)


@query()
def hidden_points(spark: SparkSession, d: str) -> DataFrame:
    """A hull has no SQL; tests hold it against every plane through three points."""
    return images.hidden_removed(fx.points(spark, d).select("point_id", "frame", *"xyz"), "frame", (0.0, 0.0, 3.0)).select("point_id")


# --- matches and precision at every threshold --------------------------------------------------------------------------

_WALK = """, edge AS (SELECT row_number() OVER (ORDER BY pred, gt) AS k, pred, gt, iou FROM pair WHERE iou >= {least}),
  walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ps, []::BIGINT[] AS gs UNION ALL SELECT e.k,
    CASE WHEN list_contains(ps, e.pred) OR list_contains(gs, e.gt) THEN ps ELSE list_append(ps, e.pred) END,
    CASE WHEN list_contains(ps, e.pred) OR list_contains(gs, e.gt) THEN gs ELSE list_append(gs, e.gt) END FROM walk w JOIN edge e ON e.k = w.k + 1),
  taken AS (SELECT unnest(ps) AS pred, unnest(gs) AS gt FROM (FROM walk ORDER BY k DESC LIMIT 1)),
  hit AS (SELECT pred, gt, iou FROM taken JOIN pair USING (pred, gt))"""


def _written_table(spark: SparkSession, d: str) -> DataFrame:
    return cut(metrics.contingency(_instances(spark, d)))


@query(f"WITH RECURSIVE {_TABLE}{_WALK.format(least=0.02)} SELECT pred, gt, round(iou, 6) + 0.0 AS iou FROM hit")
def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Many predictions ask for one truth: the first of them by id has it."""
    return _tidy(metrics.matches(metrics.iou_pairs(_written_table(spark, d)), 0.02), "iou")


@query(f"""WITH RECURSIVE {_TABLE}{_WALK.format(least=0.5)}, r AS (SELECT (SELECT count(*) FROM hit) AS tp, (SELECT avg(iou) FROM hit) AS sq,
    (SELECT count(DISTINCT pred) FROM tab WHERE pred <> 0) AS np, (SELECT count(DISTINCT gt) FROM tab WHERE gt <> 0) AS ng)
  SELECT round(tp / np, 6) + 0.0 AS precision, round(tp / ng, 6) + 0.0 AS recall, round(2 * tp / (np + ng), 6) + 0.0 AS f1,
  round(sq * 2 * tp / (np + ng), 6) + 0.0 AS panoptic FROM r""")
def precision_recall_050(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.precision_recall(_written_table(spark, d), 0.5), "precision", "recall", "f1", "panoptic")


_STEPS = ", ".join(map(str, metrics.THRESHOLDS))
_AREAS = f"""WITH RECURSIVE {_TABLE}{_WALK.format(least=0.5)}, t AS (SELECT unnest([{_STEPS}])::DOUBLE AS threshold),
  tp AS (SELECT threshold, pred FROM t, hit WHERE threshold = 0.5 UNION SELECT threshold, pred FROM t, pair WHERE threshold > 0.5 AND iou >= threshold),
  p AS (SELECT DISTINCT pred FROM tab WHERE pred <> 0),
  f AS (SELECT threshold, pred, ((threshold, pred) IN (SELECT (threshold, pred) FROM tp))::INT AS tp FROM t, p),
  c AS (SELECT threshold, pred, sum(tp) OVER w AS hits, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY threshold ORDER BY pred)),
  q AS (SELECT threshold, pred, hits / k AS p, hits / (SELECT count(DISTINCT gt) FROM tab WHERE gt <> 0) AS r FROM c),
  a AS (SELECT threshold, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS area FROM q WINDOW w AS (PARTITION BY threshold ORDER BY pred)),
  aps AS (SELECT threshold, sum(area) AS ap FROM a GROUP BY threshold)"""


@query(_AREAS + " SELECT threshold, round(ap, 6) + 0.0 AS ap FROM aps")
def average_precision_all(spark: SparkSession, d: str) -> DataFrame:
    """At 0.50, where the fold decides, and at each step up to 0.95."""
    return _tidy(metrics.average_precision(_written_table(spark, d)), "ap")


@query(_AREAS + " SELECT round(avg(ap), 6) + 0.0 AS ap FROM aps")
def mean_average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_written_table(spark, d)).agg(tidy(F.avg("ap")).alias("ap"))


# --- files -------------------------------------------------------------------------------------------------------------

_ROW = "row_number() OVER (PARTITION BY frame ORDER BY point_id) - 1 AS point_id"


def _single(*names: str) -> str:
    return ", ".join(f"round({a}::FLOAT::DOUBLE, 6) + 0.0 AS {a}" for a in names)


@query(f"WITH {fx.POINTS} SELECT frame, {_ROW}, {_single(*'xyz')} FROM points")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    """Scans of four values a point, written and read back."""
    folder = files.new_folder(spark, "scans")
    rows = fx.points(spark, d).withColumn("intensity", F.lit(0.5))
    files.write_files(rows.drop("feat"), folder, "frame", files.stacked(("x", "y", "z", "intensity"), "<f4"), "{:06d}.bin")
    found = readers.scans(spark, folder)
    return found.select("frame", "point_id", *(tidy(F.col(a).cast("double")).alias(a) for a in "xyz"))


@query(f"""WITH {fx.POINTS}, p AS (SELECT frame, {_ROW}, gt % 3 AS sem, gt AS inst FROM points) SELECT frame, point_id, sem, inst FROM p""")
def prediction_files(spark: SparkSession, d: str) -> DataFrame:
    """Packed predictions in label files, read back and unpacked."""
    folder = files.new_folder(spark, "labels")
    rows = fx.points(spark, d).select("frame", "point_id", lb.packed(F.col("gt") % 3, F.col("gt")).alias("packed"))
    files.write_files(rows, folder, "frame", files.stacked(("packed",), "<u4"), "{:06d}.label")
    found = readers.packed_labels(spark, folder)
    return found.select("frame", "point_id", lb.semantic(F.col("packed")).cast("long").alias("sem"), F.expr("packed >> 16").alias("inst"))


@query(f"WITH {fx.POINTS} SELECT frame, {_ROW}, list_transform(feat, lambda v: round(v::FLOAT::DOUBLE, 6) + 0.0) AS feat FROM points")
def feature_files(spark: SparkSession, d: str) -> DataFrame:
    folder = files.new_folder(spark, "features")
    files.write_files(fx.points(spark, d).select("frame", "point_id", "feat"), folder, "frame", files.compressed("feat"), "{:06d}.bin")
    found = readers.point_features(spark, folder, 8)
    return found.select("frame", "point_id", F.transform("feat", lambda v: tidy(v.cast("double"))).alias("feat"))


@query(f"""WITH {fx.POINTS} SELECT dense_rank() OVER (ORDER BY 'chunk' || frame || '.pcd') - 1 AS place, {_ROW}, {_single(*'xyz')} FROM points""")
def cloud_files(spark: SparkSession, d: str) -> DataFrame:
    """Clouds of chunks, read back in the order of their files' names."""
    folder = files.new_folder(spark, "clouds")
    files.write_files(fx.points(spark, d).drop("feat"), folder, "frame", files.pcd, "chunk{}.pcd")
    return _tidy(files.in_file_order(files.clouds(spark, folder)), *"xyz").select("place", "point_id", *"xyz")


@query(f"""WITH {fx.POINTS}, r AS (SELECT frame, {_ROW}, feat, gt FROM points), a AS (SELECT frame, 'feats' AS "array", point_id AS row, feat AS v FROM r
  UNION ALL SELECT frame, 'labels', point_id, [gt::DOUBLE] FROM r)
  SELECT frame || '.npz' AS name, "array", row, list_transform(v, lambda x: round(x, 6) + 0.0) AS values FROM a""")
def array_files(spark: SparkSession, d: str) -> DataFrame:
    """Masks and features as named arrays."""
    folder = files.new_folder(spark, "arrays")
    rows = fx.points(spark, d).select("frame", "point_id", F.col("feat").alias("feats"), F.array("gt").alias("labels"))
    files.write_files(rows, folder, "frame", files.arrays(("feats", "labels")), "{}.npz")
    return files.named_arrays(spark, folder).withColumn("values", F.transform("values", lambda v: tidy(v)))


@query(f"WITH {fx.POINTS}, {fx.POSES} SELECT frame, round(c, 6) + 0.0 AS cos, round(s, 6) + 0.0 AS sin, tx FROM poses")
def pose_files(spark: SparkSession, d: str) -> DataFrame:
    """Twelve numbers a line, a line a frame."""
    folder = files.new_folder(spark, "poses")
    rows = fx.poses(spark, d).select(F.lit("poses").alias("file"), "frame", "pose")
    lines = lambda part: "\n".join(" ".join(repr(float(v)) for v in p[:12]) for p in part["pose"]).encode()
    files.write_files(rows, folder, "file", lines, "{}.txt", "frame")
    m = F.col("pose")
    return readers.poses(spark, folder).select("frame", tidy(m[0]).alias("cos"), tidy(m[4]).alias("sin"), m[3].alias("tx"))


@query(f"WITH {fx.POINTS} SELECT frame % 2 AS map_id, frame AS chunk_id, count(*) AS n, round(sum(x), 4) + 0.0 AS x FROM points GROUP BY ALL")
def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    """A map's chunks as a partitioned table, and a checkpoint that is not written twice."""
    folder = files.new_folder(spark, "chunks")
    rows = fx.points(spark, d).select((F.col("frame") % 2).alias("map_id"), F.col("frame").alias("chunk_id"), "point_id", *"xyz")
    sinks.write_cloud(rows, f"{folder}/cloud")
    stored = sinks.checkpointed(spark.read.parquet(f"{folder}/cloud"), f"{folder}/checkpoint")
    again = sinks.checkpointed(stored.limit(0), f"{folder}/checkpoint")
    return again.groupBy("map_id", "chunk_id").agg(F.count("*").alias("n"), (F.round(F.sum("x"), 4) + 0.0).alias("x"))


@query(f"WITH {fx.POINTS}, t AS (SELECT DISTINCT frame FROM points) SELECT row_number() OVER (ORDER BY frame DESC) - 1 AS place, 'token' || frame AS token FROM t")
def token_list(spark: SparkSession, d: str) -> DataFrame:
    folder = files.new_folder(spark, "tokens")
    rows = fx.points(spark, d).select(F.lit("tokens").alias("file"), "frame", (-F.col("frame")).alias("order")).distinct()
    lines = lambda part: "\n\n".join(f"token{f}" for f in part["frame"]).encode() + b"\n"
    files.write_files(rows, folder, "file", lines, "{}.txt", "order")
    return files.tokens(spark, folder)


@query(f"WITH {fx.POINTS} SELECT frame, avg(gt) AS mean FROM points WHERE frame % 3 <> 0 GROUP BY frame")
def pending_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the frames that have none yet: every third has one."""
    folder = files.new_folder(spark, "reports")
    rows = fx.points(spark, d).groupBy("frame").agg(F.avg("gt").alias("mean"))
    sinks.write_report(rows.where("frame % 3 = 0"), folder)
    done = spark.read.json(folder).select(F.col("frame").cast("int").alias("frame"))
    return readers.pending(rows, done)


@query(f"WITH {fx.POINTS} SELECT point_id, gt % 7 AS sem, gt AS inst FROM points")
def label_thousands(spark: SparkSession, d: str) -> DataFrame:
    """Class times a thousand plus instance, in two bytes, read back and taken apart."""
    folder = files.new_folder(spark, "thousands")
    rows = fx.points(spark, d).where("point_id >= 0").select(F.lit(0).alias("frame"), "point_id", (F.col("gt") % 7).alias("sem"), F.col("gt").alias("inst"))
    files.write_files(rows.withColumn("packed", lb.packed_thousands(F.col("sem"), F.col("inst"))), folder, "frame", files.stacked(("packed",), "<u2"), "{:06d}.bin")
    found = readers.packed_labels(spark, folder, "<u2", "*.bin")
    order = dense_ids(fx.points(spark, d).select("point_id"), "point_id", "place")
    found = found.withColumnRenamed("point_id", "place").join(order, "place")
    return found.select("point_id", F.expr("packed div 1000").alias("sem"), lb.unpacked_thousands(F.col("packed")).cast("long").alias("inst"))


@query(f"""WITH {fx.POINTS}, t AS (SELECT point_id, row_number() OVER (PARTITION BY frame ORDER BY point_id) - 1 AS place FROM points)
  SELECT 'token' || point_id AS token, place FROM t""")
def token_chain(spark: SparkSession, d: str) -> DataFrame:
    """Samples that name the next of their scene, in the order of the chain."""
    from pyspark.sql import Window

    name = F.concat(F.lit("token"), F.col("point_id"))
    after = F.lead(name).over(Window.partitionBy("frame").orderBy("point_id"))
    return sequences.chained(fx.points(spark, d).select(name.alias("token"), after.alias("next")))


@query(f"""WITH {fx.POINTS}, {fx.POSES} SELECT frame, round(c * cos(0.4) - s * sin(0.4), 6) + 0.0 AS r00, round(c * 1 - s * 2 + tx, 6) + 0.0 AS tx,
  round(s * 1 + c * 2, 6) + 0.0 AS ty, 3::DOUBLE AS tz FROM poses""")
def sensor_chain(spark: SparkSession, d: str) -> DataFrame:
    """The vehicle's pose times the sensor's mount, which a quaternion turns."""
    turn = quaternion_rotation(F.cos(F.lit(0.2)), F.lit(0.0), F.lit(0.0), F.sin(F.lit(0.2)))
    mount = spark.range(1).select(matrix(turn, [F.lit(float(v)) for v in (1, 2, 3)]).alias("pose"))
    m = F.col("pose")
    out = readers.chained_poses(fx.poses(spark, d), mount)
    return out.select("frame", tidy(m[0]).alias("r00"), tidy(m[3]).alias("tx"), tidy(m[7]).alias("ty"), tidy(m[11]).alias("tz"))


@query("""SELECT * FROM (VALUES ('P2', 700.0::DOUBLE, 710.0::DOUBLE, 600.0::DOUBLE, 170.0::DOUBLE, 45.0::DOUBLE + 600 * 3), ('P3', 701.0, 711.0, 601.0, 171.0, 46.0 + 601 * 3))
  t(camera, fu, fv, cu, cv, shift)""")
def camera_matrices(spark: SparkSession, d: str) -> DataFrame:
    folder = files.new_folder(spark, "calib")
    rows = spark.createDataFrame([(0, i, f"P{i + 2}: {700 + i} 0 {600 + i} {45 + i} 0 {710 + i} {170 + i} 0 0 0 1 0") for i in range(2)] + [(0, 2, "Tr: 1 0 0 0 0 1 0 0 0 0 1 3")], "file int, point_id int, line string")
    files.write_files(rows, folder, "file", lambda part: "\n".join(part["line"]).encode(), "calib{}.txt")
    found = readers.cameras(readers.calibration(spark, folder))
    return found.select("camera", "fu", "fv", "cu", "cv", F.col("from_scanner")[3].alias("shift"))


@query(f"""WITH {fx.POINTS}, f AS (SELECT DISTINCT frame FROM points) SELECT camera, frame, CASE WHEN frame % 3 <> 0 THEN 'image ' || frame END AS content
  FROM f, (VALUES ('cam2'), ('cam3')) c(camera)""")
def image_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Images by camera and frame; none where the file is missing."""
    folder = files.new_folder(spark, "images")
    frames = fx.points(spark, d).select("frame").distinct()
    cams = frames.withColumn("camera", F.explode(F.array(F.lit("cam2"), F.lit("cam3"))))
    rows = cams.where("frame % 3 <> 0").withColumn("name", F.format_string("%s/%06d", "camera", "frame"))
    files.write_files(rows, folder, "name", lambda part: f"image {part['frame'].iloc[0]}".encode(), "{}.png", "frame")
    return cams.join(readers.images(spark, folder), ["camera", "frame"], "left").select("camera", "frame", F.col("content").cast("string").alias("content"))


@query(f"WITH {fx.POINTS} SELECT frame, point_id, {', '.join(f'round({a}, 6) + 0.0 AS {a}' for a in 'xyz')} FROM points")
def world_tables(spark: SparkSession, d: str) -> DataFrame:
    folder = files.new_folder(spark, "world")
    fx.points(spark, d).withColumn("t", F.lit(0.5)).write.partitionBy("frame").parquet(folder)
    return _tidy(readers.world_scans(spark, folder), *"xyz")


@query(f"""WITH {fx.POINTS}, r AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS n FROM points WHERE frame IN (1, 4, 7))
  SELECT point_id, n // 16 AS batch, n % 16 AS slot FROM r""")
def split_batches(spark: SparkSession, d: str) -> DataFrame:
    """The sequences of a split, in batches."""
    rows = sequences.in_split(fx.points(spark, d), {"train": [0, 2, 3], "valid": [1, 4, 7]}, "valid", "frame")
    return sequences.batches(rows.select("point_id"), 16, "point_id")
