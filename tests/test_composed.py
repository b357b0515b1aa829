"""Hulls, colours, folds and files against plain code."""

import itertools

import numpy as np
import pytest

from lodemap.functions import affinity
from lodemap.operators import images, masks, metrics
from lodemap.sources import files


def test_hull_corners_lie_on_a_plane_with_all_points_on_one_side():
    rng = np.random.default_rng(0)
    for kind in ("normal", "sphere", "grid"):
        points = rng.normal(size=(30, 3))
        if kind == "sphere":
            points /= np.linalg.norm(points, axis=1)[:, None]
        if kind == "grid":
            points = np.vstack([points * 0.3, np.array(list(itertools.product((-3.0, 3.0), repeat=3)))])
        corners = set()
        for i, j, k in itertools.combinations(range(len(points)), 3):
            side = (points - points[i]) @ np.cross(points[j] - points[i], points[k] - points[i])
            if (side <= 1e-9).all() or (side >= -1e-9).all():
                corners |= {i, j, k}
        assert set(images.hull_vertices(points).tolist()) == corners
    assert len(images.hull_vertices(np.zeros((0, 3)))) == 0 and len(images.hull_vertices(np.eye(3))) == 3
    assert len(images.hull_vertices(np.c_[rng.normal(size=(9, 2)), np.zeros(9)])) == 9


def test_points_behind_others_are_hidden():
    rng = np.random.default_rng(1)
    ball = rng.normal(size=(150, 3))
    ball /= np.linalg.norm(ball, axis=1)[:, None]
    seen = images.visible(np.vstack([2 * ball, 3 * ball[:40], np.zeros((1, 3))]), np.zeros(3))
    assert seen[:150].all() and not seen[150:].any()


def test_colours_are_told_apart(spark):
    n = 5_000
    rows = spark.range(-1, n).withColumn("rgb", images.colour("id"))
    assert rows.select("rgb").distinct().count() == n
    assert rows.where("id > 0").where(images.label_of("rgb") != rows["id"]).count() == 0


def test_mean_of_views_leaves_blank_ones_out(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [0.0, 0.0], [3.0, 0.0]]), (2, [[0.0, 0.0]]), (3, [])], "id int, v array<array<double>>")
    found = {r.id: r.m for r in df.select("id", affinity.mean_of_views(df["v"], 2).alias("m")).collect()}
    assert found == {1: [2.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_matches_are_the_fold_of_each_group(spark):
    rng = np.random.default_rng(2)
    rows = {(int(g), int(p), int(t)): float(rng.random()) for g, p, t in rng.integers(0, 9, (200, 3))}
    want = []
    preds, gts = set(), set()
    for (g, p, t), iou in sorted(rows.items()):
        if iou >= 0.3 and (g, p) not in preds and (g, t) not in gts:
            want.append((g, p, t))
            preds.add((g, p))
            gts.add((g, t))
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "map long, pred long, gt long, iou double")
    assert sorted((r.map, r.pred, r.gt) for r in metrics.matches(df, 0.3, ("map",)).collect()) == want
    assert metrics.matches(df.where("false"), 0.3).count() == 0


def test_lovasz_over_many_ranges(spark):
    rng = np.random.default_rng(3)
    logits, labels = np.round(rng.normal(size=(400, 3)), 1), rng.integers(0, 2, 400)
    rows = [(i, q, int(labels[i]), float(logits[i, q])) for i in range(400) for q in range(3)]
    found = {r.query: r.loss for r in masks.lovasz(spark.createDataFrame(rows, "point_id long, query int, label int, logit double"), "label").collect()}
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    for q in (0, 1):
        fg = labels == q
        err = np.where(fg, 1 - p[:, q], p[:, q])
        order = np.argsort(-err, kind="stable")
        hits, ranks = np.cumsum(fg[order]), np.arange(1, 401)
        j = 1 - (fg.sum() - hits) / (fg.sum() + ranks - hits)
        assert found[q] == pytest.approx(float((err[order] * np.diff(j, prepend=0)).sum()))
    assert set(found) == {0, 1}


def test_text_and_padded_point_clouds():
    head = "FIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nPOINTS 2\nDATA ascii\n"
    assert files.parse_pcd((head + "1 2 3 9\n4 5 6 9\n").encode()).tolist() == [[1, 2, 3], [4, 5, 6]]
    head = "FIELDS x _ y z _\nSIZE 4 1 4 4 2\nTYPE F U F F U\nCOUNT 1 3 1 1 2\nPOINTS 1\nDATA binary\n"
    raw = np.array([1], "<f4").tobytes() + b"\0\0\0" + np.array([2, 3], "<f4").tobytes() + b"\0" * 4
    assert files.parse_pcd(head.encode() + raw).tolist() == [[1, 2, 3]]
    with pytest.raises(ValueError, match="binary_compressed"):
        files.parse_pcd(b"FIELDS x y z\nPOINTS 0\nDATA binary_compressed\n")
