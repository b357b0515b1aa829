"""Instance, panoptic and association quality from label pairs; everything after the contingency table is small."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def contingency(df: DataFrame, pred: str = "pred", gt: str = "gt", groups: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*groups, F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count("*").alias("n"))


def iou_pairs(table: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of labels other than the background, with iou; sizes are over all of a label's points."""
    p = table.groupBy(*groups, "pred").agg(F.sum("n").alias("n_pred"))
    g = table.groupBy(*groups, "gt").agg(F.sum("n").alias("n_gt"))
    out = table.where("pred <> 0 and gt <> 0").join(p, [*groups, "pred"]).join(g, [*groups, "gt"])
    return out.withColumn("iou", F.col("n") / (F.col("n_pred") + F.col("n_gt") - F.col("n")))


def matches(ious: DataFrame, least: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one matches at ``iou >= least``: predictions by id take the first unused truth by id.

    Above one half a pair is the only one of both its labels, so it is a filter. Up to one half, each group's edges are folded
    in order, each looked at once; a group is a map, whose label pairs (not points) fit in a task.
    """
    edges = ious.where(F.col("iou") >= least)
    if least > 0.5:
        return edges.select(*groups, "pred", "gt", "iou")
    edges = edges.select(*groups, "pred", "gt", "iou")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken, preds, gts = [], set(), set()
        rows = rows.sort_values(["pred", "gt"])
        for i, (p, g) in enumerate(zip(rows["pred"], rows["gt"], strict=True)):
            if p not in preds and g not in gts:
                taken.append(i)
                preds.add(p)
                gts.add(g)
        return rows.iloc[taken]

    return edges.groupBy(*groups).applyInPandas(fold, edges.schema)


def _labels(table: DataFrame, side: str, groups: tuple[str, ...] = ()) -> DataFrame:
    return table.where(F.col(side) != 0).select(*groups, side).distinct()


def precision_recall(table: DataFrame, least: float = 0.5) -> DataFrame:
    """precision, recall, f1 and panoptic (mean matched iou times f1); null where there is nothing to divide by."""
    found = matches(iou_pairs(table), least).agg(F.count("*").alias("tp"), F.avg("iou").alias("sq"))
    n_pred, n_gt = (_labels(table, s).agg(F.count("*").alias(f"n_{s}")) for s in ("pred", "gt"))
    row = found.crossJoin(F.broadcast(n_pred)).crossJoin(F.broadcast(n_gt))  # one row each
    row = row.withColumn("precision", F.try_divide("tp", "n_pred")).withColumn("recall", F.try_divide("tp", "n_gt"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return row.withColumn("f1", f1).select("precision", "recall", "f1", (F.col("sq") * F.col("f1")).alias("panoptic"))


def average_precision(table: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, confidence: DataFrame | None = None) -> DataFrame:
    """threshold and ap: the area under precision over recall, from (0, 1) on, by trapezoids; predictions by confidence, then
    id. Without confidences all are equal."""
    ious = iou_pairs(table)
    preds = _labels(table, "pred")
    preds = preds.join(confidence, "pred", "left").fillna(0.5, ["conf"]) if confidence is not None else preds.withColumn("conf", F.lit(0.5))
    hits = None
    for t in thresholds:
        one = matches(ious, t).select("pred", F.lit(t).alias("threshold"), F.lit(1).alias("tp"))
        hits = one if hits is None else hits.unionByName(one)
    spread = preds.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    flagged = spread.join(hits, ["pred", "threshold"], "left").fillna(0, ["tp"])
    order = Window.partitionBy("threshold").orderBy(F.desc("conf"), "pred")  # a row for each predicted label
    n_gt = _labels(table, "gt").agg(F.count("*").alias("n_gt"))
    curve = flagged.withColumn("hit", F.sum("tp").over(order)).withColumn("rank", F.row_number().over(order))
    curve = curve.crossJoin(F.broadcast(n_gt)).withColumn("p", F.col("hit") / F.col("rank")).withColumn("r", F.col("hit") / F.col("n_gt"))
    step = (F.col("r") - F.coalesce(F.lag("r").over(order), F.lit(0.0))) * (F.col("p") + F.coalesce(F.lag("p").over(order), F.lit(1.0))) / 2
    return curve.withColumn("area", step).groupBy("threshold").agg(F.sum("area").alias("ap"))


def association(table: DataFrame, more_than: int = 200) -> DataFrame:
    """s_assoc: over true labels of more than ``more_than`` points, the mean of the sum of n·iou over the size."""
    ious = iou_pairs(table).where(F.col("n_gt") > more_than)
    per = ious.groupBy("gt").agg((F.sum(F.col("n") * F.col("iou")) / F.max("n_gt")).alias("s"))
    sizes = table.where("gt <> 0").groupBy("gt").agg(F.sum("n").alias("size")).where(F.col("size") > more_than)
    return sizes.join(per, "gt", "left").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("s_assoc"))


def semantic_iou(table: DataFrame) -> DataFrame:
    """cls, iou and accuracy (over predictions) from a confusion table of classes."""
    p = table.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("n_pred"))
    g = table.groupBy(F.col("gt").alias("cls")).agg(F.sum("n").alias("n_gt"))
    hit = table.where("pred = gt").select(F.col("pred").alias("cls"), "n")
    out = p.join(g, "cls", "full").join(hit, "cls", "left").fillna(0, ["n_pred", "n_gt", "n"])
    union = F.col("n_pred") + F.col("n_gt") - F.col("n")
    return out.select("cls", F.try_divide("n", union).alias("iou"), F.try_divide("n", "n_pred").alias("accuracy"))


def panoptic_quality(df: DataFrame, least_points: int = 50, groups: tuple[str, ...] = ()) -> DataFrame:
    """cls, tp, fp, fn, sq, rq and pq from pred_sem, pred_inst, gt_sem, gt_inst (instance 0 is none).

    Within a class, segments overlap where both say the class; a pair above one half is a match. Unmatched segments count
    from ``least_points`` points on. With ``groups`` (a frame), segments are of a group and counts are summed.
    """
    own = [*groups, "cls"]
    p = df.where("pred_inst <> 0").groupBy(*groups, F.col("pred_sem").alias("cls"), "pred_inst").agg(F.count("*").alias("n_pred"))
    g = df.where("gt_inst <> 0").groupBy(*groups, F.col("gt_sem").alias("cls"), "gt_inst").agg(F.count("*").alias("n_gt"))
    both = df.where("pred_inst <> 0 and gt_inst <> 0 and pred_sem = gt_sem")
    both = both.groupBy(*groups, F.col("gt_sem").alias("cls"), "pred_inst", "gt_inst").agg(F.count("*").alias("n"))
    both = both.join(p, [*own, "pred_inst"]).join(g, [*own, "gt_inst"])
    both = both.withColumn("iou", F.col("n") / (F.col("n_pred") + F.col("n_gt") - F.col("n"))).where("iou > 0.5")
    tp = both.groupBy("cls").agg(F.count("*").alias("tp"), F.sum("iou").alias("total"))
    fp = p.where(F.col("n_pred") >= least_points).join(both, [*own, "pred_inst"], "left_anti").groupBy("cls").agg(F.count("*").alias("fp"))
    fn = g.where(F.col("n_gt") >= least_points).join(both, [*own, "gt_inst"], "left_anti").groupBy("cls").agg(F.count("*").alias("fn"))
    every = p.select("cls").union(g.select("cls")).distinct()
    out = every.join(tp, "cls", "left").join(fp, "cls", "left").join(fn, "cls", "left").fillna(0, ["tp", "fp", "fn", "total"])
    sq = F.coalesce(F.try_divide("total", "tp"), F.lit(0.0))
    rq = F.coalesce(F.try_divide("tp", F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")), F.lit(0.0))
    return out.select("cls", "tp", "fp", "fn", sq.alias("sq"), rq.alias("rq"), (sq * rq).alias("pq"))


def panoptic_summary(quality: DataFrame, things: list[int]) -> DataFrame:
    """Mean pq, sq and rq over all classes, and mean pq of things and of stuff."""
    thing = F.col("cls").isin(things)
    return quality.agg(
        *(F.avg(c).alias(c) for c in ("pq", "sq", "rq")),
        F.avg(F.when(thing, F.col("pq"))).alias("pq_things"),
        F.avg(F.when(~thing, F.col("pq"))).alias("pq_stuff"),
    )


def panoptic_4d(df: DataFrame, least_points: int, things: list[int], group: str = "seq") -> DataFrame:
    """aq, miou and pq4d. Tubes are true instances of a sequence and class; a prediction's size pools its classes."""
    g = df.where("gt_inst <> 0").groupBy(group, "gt_sem", "gt_inst").agg(F.count("*").alias("n_gt")).where(F.col("n_gt") > least_points)
    p = df.where("pred_inst <> 0").groupBy(group, "pred_inst").agg(F.count("*").alias("n_pred"))
    both = df.where("gt_inst <> 0 and pred_inst <> 0").groupBy(group, "gt_sem", "gt_inst", "pred_inst").agg(F.count("*").alias("n"))
    both = both.join(g, [group, "gt_sem", "gt_inst"]).join(p, [group, "pred_inst"])
    total = both.agg(F.sum(F.col("n") / F.col("n_gt") * F.col("n") / (F.col("n_pred") + F.col("n_gt") - F.col("n"))).alias("total"))
    tubes = g.where(F.col("gt_sem").isin(things)).agg(F.count("*").alias("tubes"))
    iou = semantic_iou(contingency(df, "pred_sem", "gt_sem")).agg(F.avg("iou").alias("miou"))
    row = total.crossJoin(F.broadcast(tubes)).crossJoin(F.broadcast(iou)).withColumn("aq", F.try_divide("total", "tubes"))  # one row each
    return row.select("aq", "miou", F.sqrt(F.col("aq") * F.col("miou")).alias("pq4d"))


def boxes(df: DataFrame, label: str) -> DataFrame:
    """Bounds, centre and size of every label's points."""
    bounds = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max), ("c", F.avg))]
    return df.groupBy(label).agg(*bounds, F.count("*").alias("n"))
