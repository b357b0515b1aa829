import numpy as np
import pytest

from lodemap.operators import spatial


@pytest.mark.parametrize("strays", [0, 500])
def test_nearest_of_far_points(spark, monkeypatch, strays):
    """Points far from all others, ties, and groups with fewer points than asked for, by rounds alone and with the last step."""
    monkeypatch.setattr(spatial, "STRAYS", strays)
    rng = np.random.default_rng(0)
    xyz = np.round(rng.uniform(0, 3, (120, 3)), 1)
    xyz[:4] += 500
    rows = [(i, int(i % 7 == 0), *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "point_id long, side int, x double, y double, z double")
    found = spatial.knn_join(df, df, 25, 0.3, keys=("side",))
    got = {}
    for r in found.collect():
        got.setdefault(r.l_point_id, []).append((r["rank"], r.r_point_id))
    for i, side, *p in rows:
        square = lambda q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
        near = sorted((square(q), j) for j, s, *q in rows if s == side)[:25]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]
