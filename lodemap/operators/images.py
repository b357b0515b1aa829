"""Rasters as rows (u, v, value), label colours, and what a camera can see."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An odd number, so that different labels below 2**24 have different colours.
SPREAD = 0x9E3779


def colour(label: Column | str) -> Column:
    """[r, g, b] of a label, distinct for labels up to 2**24; labels of 0 and -1 are black."""
    label = F.col(label) if isinstance(label, str) else label
    code = F.pmod(label * SPREAD, F.lit(1 << 24))
    parts = [F.shiftright(code, s).bitwiseAND(255).cast("int") for s in (16, 8, 0)]
    return F.when(label > 0, F.array(*parts)).otherwise(F.array(*(F.lit(0) for _ in range(3))))


def label_of(rgb: Column | str) -> Column:
    """The label below 2**24 whose colour it is; black is 0."""
    rgb = F.col(rgb) if isinstance(rgb, str) else rgb
    code = rgb[0].cast("long") * 65536 + rgb[1] * 256 + rgb[2]
    return F.pmod(code * pow(SPREAD, -1, 1 << 24), F.lit(1 << 24))


def resized(raster: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """The raster at another size: a pixel takes the value of the source pixel that its own index falls in."""

    def targets(c: str, size: int, to: int) -> Column:  # the indices whose scaled floor is c
        first = F.ceil(F.col(c) * to / size).cast("int")
        last = (F.ceil((F.col(c) + 1) * to / size) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    rest = [c for c in raster.columns if c not in "uv"]
    rows = raster.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1))
    wide = rows.select("v", *rest, F.explode(targets("u", width, to_width)).alias("to_u"))
    return wide.select(F.col("to_u").alias("u"), F.explode(targets("v", height, to_height)).alias("v"), *rest)


def hull_vertices(points: np.ndarray) -> np.ndarray:
    """The numbers of the points that are corners of the convex hull, by adding points to it one by one.

    Each round takes the point that lies furthest outside any face, drops the faces it sees and joins their border to it.
    Fewer than four points, or points in a plane, are all corners.
    """
    n = len(points)
    scale = max(float(np.abs(points - points.mean(0)).max()), 1e-300) if n else 1.0
    least = 1e-10 * scale
    if n < 4:
        return np.arange(n)
    a = int(np.argmin(points[:, 0]))
    b = int(np.argmax(((points - points[a]) ** 2).sum(1)))
    line = points[b] - points[a]
    c = int(np.argmax((np.cross(points - points[a], line) ** 2).sum(1)))
    normal = np.cross(line, points[c] - points[a])
    heights = (points - points[a]) @ normal
    d = int(np.argmax(np.abs(heights)))
    if not np.linalg.norm(normal) or abs(heights[d]) <= least * np.linalg.norm(normal):
        return np.arange(n)
    centre = points[[a, b, c, d]].mean(0)

    def face(i: int, j: int, k: int) -> tuple[tuple[int, int, int], np.ndarray, float]:
        out = np.cross(points[j] - points[i], points[k] - points[i])
        out = out / max(np.linalg.norm(out), 1e-300)
        if out @ (centre - points[i]) > 0:
            i, j, out = j, i, -out
        return (i, j, k), out, float(out @ points[i])

    faces = [face(*f) for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))]
    outside = [np.flatnonzero(points @ f[1] - f[2] > least) for f in faces]
    while True:
        pick = next((i for i, o in enumerate(outside) if len(o)), None)
        if pick is None:
            break
        over = points[outside[pick]] @ faces[pick][1]
        new = int(outside[pick][np.argmax(over)])
        seen = [i for i, f in enumerate(faces) if points[new] @ f[1] - f[2] > least]
        edges: dict[tuple[int, int], int] = {}
        for i in seen:
            x, y, z = faces[i][0]
            for e in ((x, y), (y, z), (z, x)):
                key = (min(e), max(e))
                edges[key] = edges.get(key, 0) + 1
        left = np.unique(np.concatenate([outside[i] for i in seen]))
        left = left[left != new]
        gone = set(seen)
        faces = [f for i, f in enumerate(faces) if i not in gone]
        outside = [o for i, o in enumerate(outside) if i not in gone]
        for x, y in (e for e, times in edges.items() if times == 1):
            f = face(x, y, new)
            above = points[left] @ f[1] - f[2] > least
            faces.append(f)
            outside.append(left[above])
    return np.unique([v for f in faces for v in f[0]])


def visible(points: np.ndarray, camera: np.ndarray, factor: float = 100.0) -> np.ndarray:
    """Whether each point is seen from the camera: its reflection at a large sphere about it is a corner of the hull of all
    reflections and the camera. The sphere's radius is ``factor`` times the diagonal of the points' box. A point at the camera
    itself is not seen."""
    from_camera = points - camera
    length = np.linalg.norm(from_camera, axis=1)
    out = np.zeros(len(points), bool)
    apart = np.flatnonzero(length > 0)
    if len(apart):
        radius = factor * np.linalg.norm(points.max(0) - points.min(0))
        rays = from_camera[apart] / length[apart, None]
        flipped = from_camera[apart] + 2 * (radius - length[apart, None]) * rays
        corners = hull_vertices(np.vstack([flipped, np.zeros(3)]))
        out[apart[corners[corners < len(apart)]]] = True
    return out


def hidden_removed(df: DataFrame, frame: str, camera: tuple[float, float, float] = (0.0, 0.0, 0.0), factor: float = 100.0) -> DataFrame:
    """The rows that a camera sees in their frame; a frame is what one image shows, and fits in a task."""
    at = np.array(camera)

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        return group[visible(group[["x", "y", "z"]].to_numpy(float), at, factor)]

    return df.groupBy(frame).applyInPandas(keep, df.schema)
