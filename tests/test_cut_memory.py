import tracemalloc

import numpy as np
import pytest

from lodemap.operators import graph


def _points(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-4, 4, (6, 3))
    feat = rng.normal(size=(n, 8))
    feat[::5] = 0
    return centres[rng.integers(0, 6, n)] + rng.normal(0, 0.4, (n, 3)), feat


def _matrix(xyz, feat, alpha, theta, radius):
    w = np.zeros((len(xyz), len(xyz)))
    for i, p in enumerate(xyz):
        d = np.sqrt(((xyz - p) ** 2).sum(1))
        both = (feat != 0).any(1) & (feat[i] != 0).any()
        w[i] = np.where(d <= radius, np.exp(-alpha * d), 0) * np.exp(-theta * np.where(both, np.sqrt(((feat - feat[i]) ** 2).sum(1)), 0))
    return w


@pytest.mark.parametrize("held", [0, 4_500_000, 256_000_000])
def test_products_and_second_vector_of_tiles(monkeypatch, held):
    """With no tile, with two and with all of them held."""
    monkeypatch.setattr(graph, "MATRIX_BYTES", held)
    xyz, feat = _points(1300)
    k, w = graph.Kernel(xyz, feat, 1.0, 0.5, 20.0), _matrix(xyz, feat, 1.0, 0.5, 20.0)
    x = np.random.default_rng(1).normal(size=(1300, 3))
    assert np.allclose(k @ x, w @ x, atol=1e-6) and np.allclose(k @ x[:, 0], w @ x[:, 0], atol=1e-6)
    assert len(k.held) == min(held // (8 * graph.TILE**2), 6)
    degree = w.sum(1) + 1
    scale = 1 / np.sqrt(degree)
    values, vectors = np.linalg.eigh(scale[:, None] * (w + np.eye(1300)) * scale[None])
    assert values[-2] - values[-3] > 1e-3
    assert abs(abs(graph.second_vector(k, degree) @ vectors[:, -2]) - 1) < 1e-9
    assert graph.recursive_cut(k, 0.1).tolist() == graph.recursive_cut(w, 0.1).tolist()
    assert graph.recursive_cut(k, 0.1).max() > 1


def test_a_chunk_takes_bounded_memory(monkeypatch):
    """4,000 points: one matrix of all affinities would be 128 MB."""
    monkeypatch.setattr(graph, "MATRIX_BYTES", 30_000_000)
    xyz, feat = _points(4000)
    tracemalloc.start()
    try:
        labels = graph.recursive_cut(graph.Kernel(xyz, feat, 1.0, 0.5, 20.0), 0.05)
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()
    assert len(labels) == 4000


def test_long_chains_converge():
    """A chain's second eigenvalue is close to the first and to the next ones."""
    x = np.arange(1500) * 0.3
    w = graph.Kernel(np.c_[x, 0 * x, 0 * x], None, 1.0, 0.0, 1.0)
    side, _ = graph.best_split(w)
    assert np.count_nonzero(np.diff(side.astype(int))) == 1 and 600 < side.sum() < 900
