import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemap.functions import labels
from lodemap.functions.geometry import calibrated, matrix, transformed, transformed_back
from lodemap.operators import filters, graph, masks, merge, metrics, sampling, spatial
from lodemap.sources import readers, sinks

PRED = [0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4]
GT = [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 0, 3]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(zip(range(12), PRED, GT, strict=True)), "point_id long, pred long, gt long")


def test_min_points(pairs):
    out = filters.suppress_small(pairs, "pred", 2).orderBy("point_id").collect()
    assert [r.pred for r in out] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 0]


def test_iou_and_precision(pairs):
    table = metrics.contingency(filters.suppress_small(pairs, "pred", 2))
    found = {(r.pred, r.gt): round(r.iou, 6) for r in metrics.iou_pairs(table).collect()}
    assert found == {(1, 1): 0.75, (1, 2): 0.142857, (2, 2): 0.75, (3, 3): 0.333333}
    ap = {r.threshold: r.ap for r in metrics.average_precision(table, (0.25, *metrics.THRESHOLDS)).collect()}
    assert ap[0.25] == pytest.approx(1) and ap[0.5] == pytest.approx(2 / 3) and ap[0.75] == pytest.approx(2 / 3) and ap[0.8] == 0
    assert sum(v for t, v in ap.items() if t >= 0.5) / 10 == pytest.approx(0.4)


def test_association(pairs):
    table = metrics.contingency(filters.suppress_small(pairs, "pred", 2))
    assert metrics.association(table, 2).first().s_assoc == pytest.approx(0.6741071428571428)


def test_panoptic_person(spark):
    n, m = 60, 5
    pred = [(1, 8)] * 4 * n + [(1, 95)] * 2 * n + [(1, 35)] * m
    gt = [(1, 33)] * 3 * n + [(1, 42)] * n + [(1, 11)] * 2 * n + [(2, 7)] * m
    rows = [(*p, *g) for p, g in zip(pred, gt, strict=True)]
    df = spark.createDataFrame(rows, "pred_sem int, pred_inst int, gt_sem int, gt_inst int")
    person = next(r for r in metrics.panoptic_quality(df, 1).collect() if r.cls == 1)
    assert (person.tp, person.fp, person.fn) == (2, 1, 1)
    assert person.sq == pytest.approx(0.875) and person.pq == pytest.approx(0.583333, abs=1e-6)


def test_greedy_matches_as_a_loop(spark):
    rng = np.random.default_rng(2)
    edges = [(int(p), int(g), float(v)) for p, g, v in zip(rng.integers(1, 9, 40), rng.integers(1, 9, 40), rng.random(40), strict=True)]
    edges = sorted({(p, g): (p, g, v) for p, g, v in edges}.values())
    want, used_p, used_g = [], set(), set()
    for p, g, v in edges:
        if v >= 0.3 and p not in used_p and g not in used_g:
            want.append((p, g))
            used_p.add(p)
            used_g.add(g)
    found = metrics.matches(spark.createDataFrame(edges, "pred long, gt long, iou double"), 0.3).collect()
    assert sorted((r.pred, r.gt) for r in found) == want


def test_calibration(spark):
    row = spark.createDataFrame([(10.0, 0.0, -1.0)], "x double, y double, z double").select(*calibrated()).first()
    assert tuple(row) == pytest.approx((10.003513909665713, 0, -0.9642144259056539), abs=1e-9)


@pytest.mark.parametrize(("cls", "want"), [(10, [8, 16, 24]), (11, [9, 18, 27]), (18, [0, 0, 0]), (30, [8, 16, 24]), (32, [0, 0, 0])])
def test_instance_decode(spark, cls, want):
    df = spark.createDataFrame([((i << 16) + cls,) for i in (1, 2, 3)], "packed long")
    assert [r[0] >> 16 for r in df.select(labels.instance(F.col("packed"), "reference")).collect()] == want


def test_rigid_transform_and_back(spark):
    c, s = np.cos(0.4), np.sin(0.4)
    m = matrix([F.lit(float(v)) for v in (c, -s, 0, s, c, 0, 0, 0, 1)], [F.lit(v) for v in (1.0, 2.0, 3.0)])
    df = spark.createDataFrame([(0.5, -1.0, 2.0)], "x double, y double, z double").withColumn("m", m)
    there = df.select("m", *(v.alias(a) for a, v in zip("xyz", transformed("m"), strict=True)))
    assert tuple(there.select(*transformed_back("m")).first()) == pytest.approx((0.5, -1.0, 2.0))


def test_normalized_cut():
    square = np.array([(x, y, 0.0) for x in (0, 0.3) for y in (0, 0.3)])
    points = np.concatenate([square, square + (1.1, 0, 0)])
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    w = np.where(distance <= 1, np.exp(-distance), 0)
    assert graph.best_split(w)[1] == pytest.approx(0.191298, abs=1e-6)
    assert len(set(graph.recursive_cut(w, 0.075))) == 1
    assert graph.recursive_cut(w, 0.2).tolist() == [1] * 4 + [2] * 4


def test_assignment_is_least():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        for _ in range(20):
            cost = rng.random((n, m)).round(1)
            total = sum(cost[r, c] for r, c in masks.assignment(cost))
            short, wide = (cost, m) if n <= m else (cost.T, n)
            least = min(sum(short[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(wide), min(n, m)))
            assert total == pytest.approx(least)


def test_merge_keeps_ids_over_chunks(spark):
    box = [(x / 10, y / 10, z / 10) for x in range(4) for y in range(4) for z in range(2)]
    rows = [("m", 0, i, *p, 1) for i, p in enumerate(box)]
    rows += [("m", 1, 100 + i, p[0] + 0.05, p[1], p[2], 5) for i, p in enumerate(box)]
    rows += [("m", 1, 200 + i, p[0] + 9.0, p[1], p[2], 6) for i, p in enumerate(box)]
    chunks = spark.createDataFrame(rows, "map_id string, chunk int, point_id long, x double, y double, z double, label long")
    out = {r.point_id: r.label for r in merge.merge_map(chunks).collect()}
    assert {out[i] for i in range(32)} == {1} == {out[100 + i] for i in range(32)} and {out[200 + i] for i in range(32)} == {2}


def test_knn_is_exact(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 3)), rng.normal(size=(60, 3)) * 3
    frame = lambda v: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(v)], "point_id long, x double, y double, z double")
    found = {(r.l_point_id, r["rank"]): r.r_point_id for r in spatial.knn_join(frame(a), frame(b), 2, 0.5).collect()}
    near = np.argsort(((a[:, None] - b[None]) ** 2).sum(-1), axis=1)
    assert found == {(i, k + 1): int(near[i, k]) for i in range(40) for k in range(2)}


def test_files(spark, tmp_path):
    scan = np.arange(12, dtype="<f4")
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans/000007.bin").write_bytes(scan.tobytes())
    (tmp_path / "scans/000007.label").write_bytes(np.array([5 << 16 | 10, 3, 0], "<u4").tobytes())
    (tmp_path / "poses.txt").write_text("1 0 0 1 0 1 0 2 0 0 1 3\n1 0 0 4 0 1 0 5 0 0 1 6\n")
    (tmp_path / "calib.txt").write_text("Tr: 1 0 0 1 0 1 0 0 0 0 1 0\n")
    points = readers.scans(spark, f"file://{tmp_path}/scans").orderBy("point_id").collect()
    assert [(r.frame, r.x, r.intensity) for r in points] == [(7, 0.0, 3.0), (7, 4.0, 7.0), (7, 8.0, 11.0)]
    assert [r.packed for r in readers.packed_labels(spark, f"file://{tmp_path}/scans").orderBy("point_id").collect()] == [5 << 16 | 10, 3, 0]
    poses, calib = readers.poses(spark, f"file://{tmp_path}/poses.txt"), readers.calibration(spark, f"file://{tmp_path}/calib.txt")
    moved = readers.sensor_poses(poses, calib).orderBy("frame").collect()
    assert [r.pose[3] for r in moved] == [1.0, 4.0]
    sinks.write_report(spark.createDataFrame([(0.5,)], "ap double"), f"file://{tmp_path}/a")
    sinks.write_report(spark.createDataFrame([(0.7,)], "ap double"), f"file://{tmp_path}/b")
    assert sinks.averaged_reports(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]).first().ap == pytest.approx(0.6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "point_id long, pred long, gt long, x double, y double, z double")
    assert metrics.precision_recall(metrics.contingency(none)).first().f1 is None
    assert filters.suppress_small(none, "pred", 5).count() == 0
    assert graph.affinity_edges(none, 1.0).count() == 0


def test_samples_are_the_same_again(spark):
    df = spark.range(200).select(F.col("id").alias("point_id"), (F.col("id") % 4).alias("frame"))
    first, again = (sorted(r.point_id for r in sampling.sampled(d, 20, 3).collect()) for d in (df, df.repartition(7)))
    assert first == again and len(set(first)) == 20
    assert {r["count"] for r in sampling.sampled_per_group(df, 5, 1, "frame").groupBy("frame").count().collect()} == {5}


def test_augmentation_keeps_shapes(spark):
    rng = np.random.default_rng(1)
    rows = [(c, i, *map(float, rng.normal(size=3))) for c in (0, 1) for i in range(6)]
    df = spark.createDataFrame(rows, "frame int, point_id long, x double, y double, z double")
    out = {(r.frame, r.point_id): np.array([r.x, r.y, r.z]) for r in sampling.augmented(df, "frame", 5).collect()}
    for c in (0, 1):
        before = np.array([r[2:] for r in rows if r[0] == c])
        after = np.array([out[c, i] for i in range(6)])
        share = np.linalg.norm(after[1:] - after[0], axis=1) / np.linalg.norm(before[1:] - before[0], axis=1)
        assert np.allclose(share, share[0]) and 0.95 <= share[0] <= 1.05


def test_ground_plane_is_found(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, float(x), float(y), float(0.1 * x + 0.01 * rng.normal())) for i, (x, y) in enumerate(rng.uniform(-5, 5, (80, 2)))]
    rows += [(0, 100 + i, float(x), float(y), 2.0 + float(z)) for i, (x, y, z) in enumerate(rng.uniform(0, 3, (30, 3)))]
    df = spark.createDataFrame(rows, "frame int, point_id long, x double, y double, z double")
    marked = {r.point_id for r in sampling.ground_planes(df, "frame", 0.1).where("is_ground").collect()}
    assert set(range(80)) <= marked and len(marked) < 90
