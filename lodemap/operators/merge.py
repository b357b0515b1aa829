"""Merging labelled chunks into maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_overlap(old: DataFrame, new: DataFrame, cell: float = 1.0) -> DataFrame:
    """old, new, inside and pseudo_iou of the labels of two clouds (label, x, y, z; background 0 is left out).

    ``inside`` counts the new label's points in the old label's bounds (closed). The divisor of ``pseudo_iou`` is the number of
    distinct scalars among both labels' coordinates, which is what its customary threshold is calibrated to. Bounds meet
    points by horizontal cells.
    """
    old, new = (c.where("label <> 0") for c in (old, new))
    box = old.groupBy(F.col("label").alias("old")).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    cells = lambda a: F.sequence(F.floor(F.col(f"lo_{a}") / cell), F.floor(F.col(f"hi_{a}") / cell))
    box = box.withColumn("gx", F.explode(cells("x"))).withColumn("gy", F.explode(cells("y")))
    at = new.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell)).join(box, ["gx", "gy"])
    for a in "xyz":
        at = at.where(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    pairs = at.groupBy("old", F.col("label").alias("new")).agg(F.count("*").alias("inside"))
    scalars = lambda c, n: c.select(F.col("label").alias(n), F.explode(F.array(*"xyz")).alias("value")).distinct()
    a, b = scalars(old, "old"), scalars(new, "new")
    both = pairs.join(a, "old").join(b, ["new", "value"]).groupBy("old", "new").agg(F.count("*").alias("common"))
    out = pairs.join(a.groupBy("old").agg(F.count("*").alias("na")), "old").join(b.groupBy("new").agg(F.count("*").alias("nb")), "new")
    out = out.join(both, ["old", "new"], "left").fillna(0, ["common"])
    return out.select("old", "new", "inside", (F.col("inside") / (F.col("na") + F.col("nb") - F.col("common"))).alias("pseudo_iou"))


def merge_assignment(overlap: DataFrame, least: float = 0.01) -> DataFrame:
    """new and old: each new label takes the old one of largest pseudo_iou above ``least``, the smaller id among equals."""
    over = overlap.where(F.col("pseudo_iou") > least)
    return over.groupBy("new").agg(F.max_by("old", F.struct("pseudo_iou", -F.col("old"))).alias("old"))


def merge_map(chunks: DataFrame, least: float = 0.01, crop: float = 40.0, group: str = "map_id", key: str = "point_id") -> DataFrame:
    """Folds the chunks of each map in order: group, key and the map's label (0 background) of every distinct point.

    An instance of a chunk takes the label of the old instance it overlaps best (as ``chunk_overlap`` counts, within a cube of
    ``crop`` around the chunk), or a new one. Of points in several chunks the first stays. The order decides, so a map is one
    task; maps are of bounded length.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["chunk", key])
        points, labels, ids = np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros(0, part[key].dtype)
        fresh, known = 1, set()
        for _, chunk in part.groupby("chunk", sort=True):
            xyz, own = chunk[["x", "y", "z"]].to_numpy(), chunk["label"].to_numpy()
            near = (np.abs(points - xyz.mean(0)) <= crop / 2).all(1)
            olds = {o: points[near & (labels == o)] for o in np.unique(labels[near]) if o}
            out = np.zeros(len(own), np.int64)
            for n in np.unique(own[own != 0]):
                mine, best, taken = xyz[own == n], least, 0
                for o, theirs in sorted(olds.items()):
                    inside = ((mine >= theirs.min(0)) & (mine <= theirs.max(0))).all(1).sum()
                    iou = inside / len(np.unique(np.concatenate([mine.ravel(), theirs.ravel()])))
                    if iou > best:
                        best, taken = iou, o
                if not taken:
                    taken, fresh = fresh, fresh + 1
                out[own == n] = taken
            first = [i for i, p in enumerate(map(tuple, xyz)) if not (p in known or known.add(p))]
            points, labels = np.concatenate([points, xyz[first]]), np.concatenate([labels, out[first]])
            ids = np.concatenate([ids, chunk[key].to_numpy()[first]])
        return pd.DataFrame({group: part[group].iloc[0], key: ids, "label": labels})

    kinds = dict(chunks.dtypes)
    columns = [group, "chunk", key, "x", "y", "z", "label"]
    return chunks.select(*columns).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {key} {kinds[key]}, label long")


def refreshed_labels(df: DataFrame, matches: DataFrame, least_points: int = 20) -> DataFrame:
    """point_id and label: predictions where there are any, else the truth of labels that no match has and that hold
    ``least_points`` background points or more."""
    unmatched = df.where("gt <> 0").join(matches.select("gt").distinct(), "gt", "left_anti")
    free = unmatched.where("pred = 0").groupBy("gt").agg(F.count("*").alias("n")).where(F.col("n") >= least_points)
    out = df.join(free.select("gt", F.lit(True).alias("add")), "gt", "left")
    return out.select("point_id", F.when(F.col("pred") != 0, F.col("pred")).when(F.col("add"), -F.col("gt")).otherwise(0).alias("label"))
