"""Affinity terms between two points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feature_distance(a: Column, b: Column, missing: str = "neutral") -> Column:
    """Euclidean distance of two feature arrays. ``neutral``: 0 where one is null or all zero; ``raw``: they count as seen."""
    square = F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    distance = F.sqrt(square)
    if missing == "raw":
        return distance
    seen = lambda v: F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    return F.when(seen(a) & seen(b), distance).otherwise(F.lit(0.0))


def kernel(distance: Column, weight: float) -> Column:
    return F.exp(-F.lit(weight) * distance)


def view_disagreement(a: Column, b: Column, unseen: int = -1) -> Column:
    """The share of views with different labels among those that label both points; 0 without such views."""
    both = F.filter(F.zip_with(a, b, lambda p, q: F.when((p != unseen) & (q != unseen), (p != q).cast("int"))), lambda v: v.isNotNull())
    wrong = F.aggregate(both, F.lit(0), lambda s, v: s + v)
    return F.when(F.size(both) > 0, wrong / F.size(both)).otherwise(F.lit(0.0))


def mean_of_views(views: Column, size: int) -> Column:
    """The mean of the feature arrays that are not all zero, of an array of such arrays; zeros where there is none."""
    seen = F.filter(views, lambda v: F.exists(v, lambda e: e != 0))
    total = lambda i: F.aggregate(seen, F.lit(0.0), lambda s, v: s + v[i])
    return F.array(*(F.when(F.size(seen) > 0, total(i) / F.size(seen)).otherwise(F.lit(0.0)) for i in range(size)))
