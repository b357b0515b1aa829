import numpy as np

from lodemap.operators import spatial


def test_nearest_of_dense_points(spark, monkeypatch):
    """All points within the first radius of each other, a place with many copies, and few points far away: the pairs that are
    compared stay some multiple of the answer."""
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.uniform(0, 0.05, (1200, 2)), np.full((300, 2), 0.02), rng.uniform(0, 5, (30, 2))])
    rows = [(int(i), float(x), float(y), 0.0) for i, (x, y) in zip(rng.permutation(len(xy)), xy, strict=True)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    pairs, join = [], spatial.grid_join

    def counted(*args):
        pairs.append(join(*args).count())
        return join(*args)

    monkeypatch.setattr(spatial, "grid_join", counted)
    got = {}
    for r in spatial.knn_join(df, df, 5, 0.1).collect():
        got.setdefault(r.l_point_id, []).append((r["rank"], r.r_point_id))
    assert sum(pairs) < 100 * len(rows)
    for i, x, y, _ in rows:
        near = sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for j, u, v, _ in rows)[:5]
        assert [j for _, j in sorted(got[i])] == [j for _, j in near]
