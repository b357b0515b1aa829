"""Affinity graphs, normalized cuts, connected components and density clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions.affinity import feature_distance, kernel, view_disagreement

from .spatial import grid_join, self_pairs
from .stages import cut

#: Rows and columns of a tile of affinities, and the bytes of tiles that a task holds, at most.
TILE, MATRIX_BYTES = 512, 256_000_000
#: The residual at which an eigenvector is found.
RESIDUAL = 1e-12


def affinity_edges(
    df: DataFrame, alpha: float, theta: float = 0.0, feature: str | None = None, radius: float = 1.0, missing: str = "neutral",
    key: str = "point_id", chunk: tuple[str, ...] = (),
) -> DataFrame:
    """i < j and w = exp(-alpha·distance)·exp(-theta·feature distance) for points within ``radius``, per chunk."""
    pairs = self_pairs(df, radius, key, chunk)
    w = kernel(F.sqrt("d2"), alpha)
    if feature:
        w = w * kernel(feature_distance(F.col(f"l_{feature}"), F.col(f"r_{feature}"), missing), theta)
    return pairs.select(*(F.col(f"l_{c}").alias(c) for c in chunk), F.col(f"l_{key}").alias("i"), F.col(f"r_{key}").alias("j"), w.alias("w"))


def camera_affinity(
    df: DataFrame, alpha: float, beta: float, gamma: float, theta: float, views: tuple[str, ...], images: tuple[str, ...], feature: str,
    radius: float = 1.0, key: str = "point_id", chunk: tuple[str, ...] = (),
) -> DataFrame:
    """i < j and w for points within ``radius``: the product of the kernels of their distance (``alpha``), of the share of views
    that label them differently, for each camera's column of ``views`` (``beta``), of the distance of each camera's mean image
    features in ``images`` (``gamma``; features of zero count as seen), and of the distance of their point features (``theta``;
    no distance where one has none). A weight of 0 leaves its factor out."""
    pairs = self_pairs(df, radius, key, chunk)
    both = lambda c: (F.col(f"l_{c}"), F.col(f"r_{c}"))
    w = kernel(F.sqrt("d2"), alpha)
    for c in views if beta else ():
        w = w * kernel(view_disagreement(*both(c)), beta)
    for c in images if gamma else ():
        w = w * kernel(feature_distance(*both(c), "raw"), gamma)
    if theta:
        w = w * kernel(feature_distance(*both(feature)), theta)
    return pairs.select(*(F.col(f"l_{c}").alias(c) for c in chunk), F.col(f"l_{key}").alias("i"), F.col(f"r_{key}").alias("j"), w.alias("w"))


def cut_costs(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """cut and ncut of a bipartition (point_id, side 0 or 1). The weight between the sides is of the graph with unit diagonal;
    a side's association counts one more per point, as the cut is sought on the graph plus the identity."""
    of = lambda c: sides.select(F.col("point_id").alias(c), F.col("side").alias(f"s{c}"))
    both = edges.join(of("i"), "i").join(of("j"), "j")
    sums = both.agg(
        F.coalesce(F.sum(F.when(F.col("si") != F.col("sj"), F.col("w"))), F.lit(0.0)).alias("cut"),
        *(F.coalesce(F.sum(F.col("w") * ((F.col("si") == s).cast("int") + (F.col("sj") == s).cast("int"))), F.lit(0.0)).alias(f"w{s}") for s in (0, 1)),
    )
    sizes = sides.agg(*(F.count(F.when(F.col("side") == s, 1)).alias(f"n{s}") for s in (0, 1)))
    ncut = sum((F.col("cut") / (F.col(f"w{s}") + 2 * F.col(f"n{s}")) for s in (0, 1)), F.lit(0.0))
    return sums.crossJoin(F.broadcast(sizes)).select("cut", ncut.alias("ncut"))  # one row each


def isolated_removed(df: DataFrame, edges: DataFrame, key: str = "point_id") -> DataFrame:
    """Points with an edge to another."""
    return df.join(edges.select(F.explode(F.array("i", "j")).alias(key)).distinct(), key, "left_semi")


class Kernel:
    """The affinities of points within ``radius``, as a matrix that is never held whole: products go tile by tile over its upper
    half. Tiles stay while they fit into ``MATRIX_BYTES``; the others are made again for every product."""

    def __init__(self, xyz: np.ndarray, feat: np.ndarray | None, alpha: float, theta: float, radius: float):
        self.xyz, self.feat, self.alpha, self.theta, self.radius = xyz, feat, alpha, theta, radius
        self.seen = None if feat is None else (feat != 0).any(1)
        self.held: dict[tuple[int, int], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.xyz)

    def part(self, ids: np.ndarray) -> Kernel:
        return Kernel(self.xyz[ids], None if self.feat is None else self.feat[ids], self.alpha, self.theta, self.radius)

    def _tile(self, i: int, j: int) -> np.ndarray:
        found = self.held.get((i, j))
        if found is not None:
            return found
        u, v = slice(i, i + TILE), slice(j, j + TILE)
        distance = np.sqrt(sum((self.xyz[u, None, a] - self.xyz[None, v, a]) ** 2 for a in range(3)))
        w = np.where(distance <= self.radius, np.exp(-self.alpha * distance), 0.0)
        if self.feat is not None:
            a, b = self.feat[u], self.feat[v]
            apart = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
            w *= np.exp(-self.theta * np.where(self.seen[u, None] & self.seen[None, v], apart, 0.0))
        if (len(self.held) + 1) * 8 * TILE**2 <= MATRIX_BYTES:
            self.held[i, j] = w
        return w

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for i in range(0, len(self), TILE):
            for j in range(i, len(self), TILE):
                w = self._tile(i, j)
                out[i : i + TILE] += w @ x[j : j + TILE]
                if i != j:
                    out[j : j + TILE] += w.T @ x[i : i + TILE]
        return out


def second_vector(w: np.ndarray | Kernel, degree: np.ndarray) -> np.ndarray:
    """The second eigenvector of the normalized Laplacian of ``w`` plus the identity, whose degrees are given, by Lanczos steps
    that are kept orthogonal to all before them and to the first eigenvector, which is known. They end when the residual is
    rounding, or span the space."""
    n = len(degree)
    scale, first = 1 / np.sqrt(degree), np.sqrt(degree / degree.sum())
    v = np.random.default_rng(0).standard_normal(n)
    v -= first * (first @ v)
    v /= np.linalg.norm(v)
    basis, diagonal, beside, look = np.empty((min(n, 32), n)), [], [], 8
    while True:
        m = len(diagonal)
        if m == len(basis):
            basis = np.concatenate([basis, np.empty((min(m, n - m), n))])
        basis[m] = v
        y = scale * v
        y = scale * (w @ y + y)
        diagonal.append(v @ y)
        m += 1
        for _ in range(2):
            y -= first * (first @ y)
            y -= basis[:m].T @ (basis[:m] @ y)
        rest = np.linalg.norm(y)
        last = rest < RESIDUAL or m == n - 1
        if last or m == look:
            _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
            if last or rest * abs(vectors[-1, -1]) < RESIDUAL:
                return vectors[:, -1] @ basis[:m]
            look += max(8, m // 4)
        beside.append(rest)
        v = y / rest


def best_split(w: np.ndarray | Kernel, cuts: int = 10) -> tuple[np.ndarray | None, float]:
    """The least normalized cut among evenly spaced thresholds of the second eigenvector; none for a constant one."""
    degree = w @ np.ones(len(w)) + 1.0
    v = second_vector(w, degree)
    v = v * np.sign(v[np.argmax(np.abs(v))])  # a sign of its own
    low, high = v.min(), v.max()
    if np.isclose(low, high):
        return None, np.inf
    sides = v[:, None] > (low + (high - low) * np.arange(cuts) / cuts)[None]
    between = w @ sides.astype(float)
    best, least = None, np.inf
    for side, near in zip(sides.T, between.T, strict=True):
        if side.all() or not side.any():
            continue
        across = near[~side].sum()
        cost = across / degree[side].sum() + across / degree[~side].sum()
        if cost < least:
            best, least = side, cost
    return best, least


def recursive_cut(w: np.ndarray | Kernel, threshold: float, least_share: float = 0.01) -> np.ndarray:
    """A label for each point: groups are split while their best cut costs less than ``threshold``, and they hold more than a
    share of the points and more than two, whether connected or not. Labels are numbered by their first point."""
    n = len(w)
    todo, leaves = [np.arange(n)], []
    while todo:
        ids = todo.pop()
        if len(ids) > 2 and len(ids) > least_share * n:
            side, cost = best_split(w.part(ids) if isinstance(w, Kernel) else w[np.ix_(ids, ids)])
            if side is not None and cost < threshold:
                todo += [ids[side], ids[~side]]
                continue
        leaves.append(ids)
    label = np.zeros(n, np.int64)
    for number, ids in enumerate(sorted(leaves, key=lambda x: x.min()), 1):
        label[ids] = number
    return label


def ncut_labels(df: DataFrame, chunk: str, threshold: float, alpha: float, theta: float = 0.0, radius: float = 1.0, key: str = "point_id") -> DataFrame:
    """chunk, key and label (from 1) of normalized cuts within each chunk; a chunk is a bounded cube of voxels.

    Features (``feat``) count by ``theta``; points without any are neutral.
    """

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        feat = np.stack(group["feat"].to_list()).astype(float) if theta else None
        w = Kernel(group[["x", "y", "z"]].to_numpy(), feat, alpha, theta, radius)
        return pd.DataFrame({chunk: group[chunk], key: group[key], "label": recursive_cut(w, threshold)})

    kinds = dict(df.dtypes)
    columns = [chunk, key, *"xyz"] + (["feat"] if theta else [])
    return df.select(*columns).groupBy(chunk).applyInPandas(label, f"{chunk} {kinds[chunk]}, {key} {kinds[key]}, label long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node) of the nodes of edges (i, j): every node joins its least neighbour, joined nodes are
    one, until no edge is left between different ones."""
    pairs = cut(edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct())
    roots = cut(pairs.select(F.explode(F.array("i", "j")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not pairs.isEmpty():
        both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
        parent = both.groupBy("i").agg(F.min("j").alias("p")).select("i", F.least("i", "p").alias("p"))
        parent = cut(parent)
        up = parent.select(F.col("i").alias("p"), F.col("p").alias("pp"))
        parent = cut(parent.join(up, "p", "left").select("i", F.coalesce("pp", "p").alias("p")))
        to = parent.select(F.col("i").alias("root"), F.col("p").alias("to"))
        roots = cut(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a, b = (parent.select(F.col("i").alias(c), F.col("p").alias(f"p{c}")) for c in "ij")
        ends = pairs.join(a, "i").join(b, "j").select(F.least("pi", "pj").alias("i"), F.greatest("pi", "pj").alias("j"))
        pairs = cut(ends.where("i <> j").distinct())
    return roots


def dbscan(df: DataFrame, radius: float, least: int, key: str = "point_id") -> DataFrame:
    """key and label: the least core point of the density cluster, or -1 for noise. A border point takes the least cluster of
    its core neighbours. A point is its own neighbour."""
    near = grid_join(df.select(key, *"xyz"), df.select(key, *"xyz"), radius).select(F.col(f"l_{key}").alias("i"), F.col(f"r_{key}").alias("j"))
    near = cut(near)
    core = near.groupBy("i").count().where(F.col("count") >= least).select(F.col("i").alias("core"))
    ends = near.join(core, F.col("i") == F.col("core"), "left_semi").join(core, F.col("j") == F.col("core"), "left_semi")
    roots = components(ends)
    label = core.join(roots, core["core"] == roots["node"], "left").select("core", F.coalesce("root", "core").alias("label"))
    reached = near.join(label, F.col("j") == F.col("core")).groupBy("i")
    reached = reached.agg(F.min("label").alias("border"), F.max(F.when(F.col("i") == F.col("core"), F.col("label"))).alias("own"))
    found = reached.select(F.col("i").alias(key), F.coalesce("own", "border").alias("label"))
    return df.select(key).join(found, key, "left").select(key, F.coalesce("label", F.lit(-1)).alias("label"))


def merge_near(centres: DataFrame, radius: float, label: str = "label") -> DataFrame:
    """label and merged: each label takes the least label whose centre is within ``radius``, in a single pass."""
    pairs = grid_join(centres, centres, radius)
    return pairs.groupBy(F.col(f"l_{label}").alias(label)).agg(F.min(f"r_{label}").alias("merged"))
