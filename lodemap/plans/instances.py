"""Queries on graphs, instance metrics, masks and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import affinity
from lodemap.functions.geometry import tidy
from lodemap.operators import filters, graph, masks, merge, metrics
from lodemap.operators.stages import cut
from lodemap.sources import fixtures as fx

from .registry import query

R = "round({0}, 6) + 0.0 AS {1}"

# seven of ten points keep an id made of the truth, the others have the number of their cell
_PRED = "CASE WHEN point_id % 10 < 7 AND gt > 1 THEN gt * 10 WHEN point_id % 10 < 9 THEN 0 ELSE pred END"
_INST = f"{fx.PREDICTED}, inst AS (SELECT point_id, frame, x, y, z, gt, {_PRED} AS pred FROM predicted)"
_TABLE = f"""{_INST}, tab AS (SELECT pred, gt, count(*) AS n FROM inst GROUP BY ALL),
  pair AS (SELECT pred, gt, n, np, ng, n / (np + ng - n) AS iou FROM tab JOIN (SELECT pred, sum(n) AS np FROM tab GROUP BY pred) USING (pred)
    JOIN (SELECT gt, sum(n) AS ng FROM tab GROUP BY gt) USING (gt) WHERE pred <> 0 AND gt <> 0)"""


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return fx.predicted(spark, d).withColumn("pred", F.expr(_PRED)).select("point_id", "frame", *"xyz", "gt", "pred")


def _table(spark: SparkSession, d: str) -> DataFrame:
    return metrics.contingency(_instances(spark, d))


def _tidy(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in columns})


@query(f"WITH {_INST} SELECT point_id, CASE WHEN count(*) OVER (PARTITION BY pred) < 5 THEN 0 ELSE pred END AS pred FROM inst")
def min_points(spark: SparkSession, d: str) -> DataFrame:
    return filters.suppress_small(_instances(spark, d), "pred", 5).select("point_id", "pred")


@query(f"WITH {_INST} SELECT point_id, CASE WHEN avg((gt = 0)::INT) OVER (PARTITION BY pred) > 0.8 THEN 0 ELSE pred END AS pred FROM inst")
def remove_semantics(spark: SparkSession, d: str) -> DataFrame:
    return filters.suppress_background(_instances(spark, d), "pred", "gt").select("point_id", "pred")


@query(f"""WITH {_INST}, top AS (SELECT pred FROM inst GROUP BY pred ORDER BY count(*) DESC, pred LIMIT 5)
  SELECT point_id, CASE WHEN pred IN (FROM top) THEN pred ELSE -1 END AS pred FROM inst""")
def topk_clusters(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_largest(_instances(spark, d), "pred", 5).select("point_id", "pred")


@query(f"""WITH {_INST}, s AS (SELECT frame, pred, row_number() OVER (PARTITION BY frame ORDER BY count(*) DESC, pred) AS k FROM inst GROUP BY frame, pred)
  SELECT point_id, CASE WHEN pred = top THEN 0 ELSE pred END AS pred FROM inst JOIN (SELECT frame, pred AS top FROM s WHERE k = 1) USING (frame)""")
def largest_background(spark: SparkSession, d: str) -> DataFrame:
    return filters.largest_to_background(_instances(spark, d), "pred", ("frame",)).select("point_id", "pred")


@query(f"""WITH {_INST}, c AS (SELECT pred AS l FROM inst GROUP BY 1 HAVING count(*) > 2 INTERSECT SELECT gt * 10 FROM inst GROUP BY 1 HAVING count(*) > 2),
  k AS (SELECT l FROM c WHERE l > (SELECT min(l) FROM c))
  SELECT point_id, CASE WHEN pred IN (FROM k) THEN pred ELSE -1 END AS pred, CASE WHEN gt * 10 IN (FROM k) THEN gt * 10 ELSE -1 END AS gt FROM inst""")
def common_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _instances(spark, d).withColumn("gt", F.col("gt") * 10)
    return filters.common_labels(rows, "pred", "gt", 2).select("point_id", "pred", "gt")


@query(f"WITH {_INST} SELECT point_id FROM inst WHERE frame IN (SELECT frame FROM inst GROUP BY frame HAVING count(DISTINCT gt) > 1)")
def several_labels(spark: SparkSession, d: str) -> DataFrame:
    return filters.several_labels(_instances(spark, d), "frame", "gt").select("point_id")


@query(f"""WITH {_INST}, m AS (SELECT pred, avg(abs(x)) AS conf FROM inst GROUP BY pred ORDER BY conf DESC, pred LIMIT 20)
  SELECT point_id, round(conf, 6) + 0.0 AS mean_conf FROM inst JOIN m USING (pred) WHERE conf > 0.1""")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _instances(spark, d).withColumn("conf", F.abs("x"))
    return _tidy(filters.confident(rows, "pred", "conf", 20, 0.1).select("point_id", "mean_conf"), "mean_conf")


# --- graphs ------------------------------------------------------------------------------------------------------------

_EDGES = f"""{fx.POINTS}, e AS (SELECT a.frame, a.point_id AS i, b.point_id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)
  + (a.z - b.z) * (a.z - b.z)) AS d, CASE WHEN len(list_filter(a.feat, lambda v: v <> 0)) > 0 AND len(list_filter(b.feat, lambda v: v <> 0)) > 0
  THEN list_distance(a.feat, b.feat) ELSE 0 END AS f FROM points a JOIN points b ON a.frame = b.frame AND a.point_id < b.point_id)"""


@query(f"WITH {_EDGES} SELECT frame, i, j, round(exp(-1.0 * d) * exp(-0.5 * f), 6) + 0.0 AS w FROM e WHERE d <= 0.15")
def affinity_edges(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(graph.affinity_edges(fx.points(spark, d), 1.0, 0.5, "feat", 0.15, chunk=("frame",)), "w")


@query(f"""WITH {_EDGES}, w AS (SELECT i, j, i % 3 = 0 AS si, j % 3 = 0 AS sj, exp(-d) AS w FROM e WHERE d <= 0.2),
  s AS (SELECT sum(w) FILTER (si <> sj) AS cut, sum(w * (si::INT + sj::INT)) AS w1, sum(w * ((NOT si)::INT + (NOT sj)::INT)) AS w0 FROM w),
  n AS (SELECT count(*) FILTER (point_id % 3 = 0) AS n1, count(*) FILTER (point_id % 3 <> 0) AS n0 FROM points)
  SELECT round(cut, 6) + 0.0 AS cut, round(cut / (w0 + 2 * n0) + cut / (w1 + 2 * n1), 6) + 0.0 AS ncut FROM s, n""")
def cut_cost(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    edges = graph.affinity_edges(p, 1.0, radius=0.2, chunk=("frame",))
    return _tidy(graph.cut_costs(edges, p.select("point_id", (F.col("point_id") % 3 == 0).cast("int").alias("side"))), "cut", "ncut")


@query(f"WITH {_EDGES} SELECT point_id FROM points WHERE point_id IN (SELECT i FROM e WHERE d <= 0.08 UNION SELECT j FROM e WHERE d <= 0.08)")
def isolated_removed(spark: SparkSession, d: str) -> DataFrame:
    p = fx.points(spark, d)
    return graph.isolated_removed(p, graph.affinity_edges(p, 1.0, radius=0.08, chunk=("frame",))).select("point_id")


@query()
def ncut_labels(spark: SparkSession, d: str) -> DataFrame:
    """Eigenvectors have no SQL; tests hold the cuts against a fixed case."""
    return graph.ncut_labels(fx.points(spark, d), "frame", 0.075, 1.0, 0.5)


@query(f"""WITH RECURSIVE {fx.POINTS}, near AS (SELECT a.point_id AS i, b.point_id AS j FROM points a, points b WHERE (a.x - b.x) * (a.x - b.x)
  + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.05 * 0.05), core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4),
  link AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
  walk AS (SELECT i AS a, i AS b FROM core UNION SELECT a, j FROM walk JOIN link ON b = i), root AS (SELECT a, min(b) AS label FROM walk GROUP BY a),
  got AS (SELECT n.i, coalesce(max(CASE WHEN n.i = n.j THEN label END), min(label)) AS label FROM near n JOIN root ON n.j = a GROUP BY n.i)
  SELECT point_id, coalesce(label, -1) AS label FROM points LEFT JOIN got ON point_id = i""")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return graph.dbscan(fx.points(spark, d), 0.05, 4)


@query(f"""WITH {fx.POINTS}, c AS (SELECT gt AS label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points GROUP BY gt)
  SELECT a.label, min(b.label) AS merged FROM c a, c b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.01 GROUP BY a.label""")
def centroid_merge(spark: SparkSession, d: str) -> DataFrame:
    centres = fx.points(spark, d).groupBy(F.col("gt").alias("label")).agg(*(F.avg(a).alias(a) for a in "xyz"))
    return graph.merge_near(centres, 0.1)


@query(f"""WITH {fx.POINTS}, v AS (SELECT point_id, [gt % 3 - 1, point_id % 4 - 1, frame % 2] AS views FROM points),
  p AS (SELECT a.point_id AS i, b.point_id AS j, list_zip(a.views, b.views) AS z FROM v a JOIN v b ON b.point_id = a.point_id + 1),
  s AS (SELECT i, j, list_filter(z, lambda t: t[1] <> -1 AND t[2] <> -1) AS z FROM p)
  SELECT i, j, round(CASE WHEN len(z) > 0 THEN len(list_filter(z, lambda t: t[1] <> t[2])) / len(z) ELSE 0 END, 6) + 0.0 AS share FROM s""")
def view_disagreement(spark: SparkSession, d: str) -> DataFrame:
    v = fx.points(spark, d).select("point_id", F.array(*(F.expr(f"cast({e} as int)") for e in ("gt % 3 - 1", "point_id % 4 - 1", "frame % 2"))).alias("views"))
    a = v.select(F.col("point_id").alias("i"), F.col("views").alias("a"))
    b = v.select(F.col("point_id").alias("j"), F.col("views").alias("b"))
    out = a.join(b, F.col("j") == F.col("i") + 1).select("i", "j", affinity.view_disagreement(F.col("a"), F.col("b")).alias("share"))
    return _tidy(out, "share")


# --- metrics -----------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey AS pred, l_partkey % 50 AS gt, count(*) AS n FROM lineitem GROUP BY ALL")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    """Label pairs of the table with the most rows."""
    rows = fx.table(spark, d, "lineitem")
    return metrics.contingency(rows.select(F.col("l_suppkey").alias("pred"), (F.col("l_partkey") % 50).alias("gt")))


@query(f"WITH {_TABLE} SELECT pred, gt, {R.format('iou', 'iou')} FROM pair")
def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.iou_pairs(_table(spark, d)).select("pred", "gt", "iou"), "iou")


@query(f"WITH {_TABLE} SELECT pred, gt, {R.format('iou', 'iou')} FROM pair WHERE iou >= 0.55")
def match_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.matches(metrics.iou_pairs(_table(spark, d)), 0.55), "iou")


@query()
def greedy_match_025(spark: SparkSession, d: str) -> DataFrame:
    """An ordered fold; tests hold it against a loop."""
    return _tidy(metrics.matches(metrics.iou_pairs(_table(spark, d)), 0.02), "iou")


_PRF = """, r AS (SELECT (SELECT count(*) FROM pair WHERE iou >= 0.55) AS tp, (SELECT avg(iou) FROM pair WHERE iou >= 0.55) AS sq,
  (SELECT count(DISTINCT pred) FROM tab WHERE pred <> 0) AS np, (SELECT count(DISTINCT gt) FROM tab WHERE gt <> 0) AS ng)"""


@query(f"WITH {_TABLE}{_PRF} SELECT round(tp / np, 6) + 0.0 AS precision, round(tp / ng, 6) + 0.0 AS recall, round(2 * tp / (np + ng), 6) + 0.0 AS f1, round(sq * 2 * tp / (np + ng), 6) + 0.0 AS panoptic FROM r")
def prf1(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.precision_recall(_table(spark, d), 0.55), "precision", "recall", "f1", "panoptic")


_AP = f"""WITH {_TABLE}, t AS (SELECT unnest([0.55, 0.6, 0.65, 0.7, 0.75]) AS threshold), p AS (SELECT DISTINCT pred FROM tab WHERE pred <> 0),
  f AS (SELECT threshold::DOUBLE AS threshold, pred, coalesce((SELECT max((iou >= threshold)::INT) FROM pair q WHERE q.pred = p.pred), 0) AS tp FROM t, p),
  c AS (SELECT threshold, pred, sum(tp) OVER w AS hit, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY threshold ORDER BY pred)),
  d AS (SELECT threshold, pred, hit / k AS p, hit / (SELECT count(DISTINCT gt) FROM tab WHERE gt <> 0) AS r FROM c),
  a AS (SELECT threshold, (r - coalesce(lag(r) OVER w, 0)) * (p + coalesce(lag(p) OVER w, 1)) / 2 AS area FROM d WINDOW w AS (PARTITION BY threshold ORDER BY pred))"""


@query(_AP + " SELECT threshold, round(sum(area), 6) + 0.0 AS ap FROM a GROUP BY threshold")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.average_precision(_table(spark, d), (0.55, 0.6, 0.65, 0.7, 0.75)), "ap")


_ASSOC = """, g AS (SELECT gt, sum(n) AS size FROM tab WHERE gt <> 0 GROUP BY gt HAVING sum(n) > 20),
  s AS (SELECT gt, sum(n * iou) / max(ng) AS s FROM pair GROUP BY gt)"""


@query(f"WITH {_TABLE}{_ASSOC} SELECT round(avg(coalesce(s, 0)), 6) + 0.0 AS s_assoc FROM g LEFT JOIN s USING (gt)")
def s_assoc(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.association(_table(spark, d), 20), "s_assoc")


@query(f"""WITH {_TABLE}{_PRF}{_ASSOC} SELECT round(tp / np, 6) + 0.0 AS precision, round(tp / ng, 6) + 0.0 AS recall, round(2 * tp / (np + ng), 6) + 0.0
  AS f1, (SELECT round(avg(coalesce(s, 0)), 6) + 0.0 FROM g LEFT JOIN s USING (gt)) AS s_assoc FROM r""")
def instance_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and association of one map."""
    tab = cut(_table(spark, d))  # every figure reads it
    row = metrics.precision_recall(tab, 0.55).crossJoin(F.broadcast(metrics.association(tab, 20)))  # one row each
    return _tidy(row.select("precision", "recall", "f1", "s_assoc"), "precision", "recall", "f1", "s_assoc")


_SEM = f"{_INST}, sem AS (SELECT frame, point_id, gt % 3 AS gt_sem, gt AS gt_inst, CASE WHEN point_id % 5 = 0 THEN 2 ELSE gt % 3 END AS pred_sem, pred AS pred_inst FROM inst)"


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.when(F.col("point_id") % 5 == 0, 2).otherwise(F.col("gt") % 3)
    return _instances(spark, d).select(
        "frame", "point_id", (F.col("gt") % 3).alias("gt_sem"), F.col("gt").alias("gt_inst"), wrong.alias("pred_sem"), F.col("pred").alias("pred_inst")
    )


_MIOU = """c AS (SELECT cls, count(*) FILTER (pred_sem = cls) AS np, count(*) FILTER (gt_sem = cls) AS ng, count(*) FILTER (pred_sem = cls AND gt_sem = cls) AS n
  FROM sem, (SELECT DISTINCT unnest([pred_sem, gt_sem]) AS cls FROM sem) GROUP BY cls)"""


@query(f"WITH {_SEM}, {_MIOU} SELECT cls, round(n / (np + ng - n), 6) + 0.0 AS iou, round(n / np, 6) + 0.0 AS accuracy FROM c")
def semantic_iou(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.semantic_iou(metrics.contingency(_semantic(spark, d), "pred_sem", "gt_sem")), "iou", "accuracy")


_PQ = f"""WITH {_SEM}, p AS (SELECT pred_sem AS cls, pred_inst, count(*) AS np FROM sem WHERE pred_inst <> 0 GROUP BY ALL),
  g AS (SELECT gt_sem AS cls, gt_inst, count(*) AS ng FROM sem WHERE gt_inst <> 0 GROUP BY ALL),
  b AS (SELECT gt_sem AS cls, pred_inst, gt_inst, count(*) AS n FROM sem WHERE pred_inst <> 0 AND gt_inst <> 0 AND pred_sem = gt_sem GROUP BY ALL),
  m AS (SELECT cls, pred_inst, gt_inst, n / (np + ng - n) AS iou FROM b JOIN p USING (cls, pred_inst) JOIN g USING (cls, gt_inst) WHERE n / (np + ng - n) > 0.5),
  k AS (SELECT DISTINCT cls FROM (SELECT cls FROM p UNION SELECT cls FROM g)),
  q AS (SELECT cls, (SELECT count(*) FROM m WHERE m.cls = k.cls) AS tp, (SELECT coalesce(sum(iou), 0) FROM m WHERE m.cls = k.cls) AS total,
    (SELECT count(*) FROM p WHERE p.cls = k.cls AND np >= 10 AND pred_inst NOT IN (SELECT pred_inst FROM m WHERE m.cls = k.cls)) AS fp,
    (SELECT count(*) FROM g WHERE g.cls = k.cls AND ng >= 10 AND gt_inst NOT IN (SELECT gt_inst FROM m WHERE m.cls = k.cls)) AS fn FROM k),
  z AS (SELECT cls, tp, fp, fn, CASE WHEN tp > 0 THEN total / tp ELSE 0 END AS sq, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + 0.5 * fp + 0.5 * fn) ELSE 0 END AS rq FROM q)"""


@query(_PQ + " SELECT cls, tp, fp, fn, round(sq, 6) + 0.0 AS sq, round(rq, 6) + 0.0 AS rq, round(sq * rq, 6) + 0.0 AS pq FROM z")
def pq(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.panoptic_quality(_semantic(spark, d), 10), "sq", "rq", "pq")


@query(_PQ + """ SELECT round(avg(sq * rq), 6) + 0.0 AS pq, round(avg(sq), 6) + 0.0 AS sq, round(avg(rq), 6) + 0.0 AS rq,
  round(avg(sq * rq) FILTER (cls IN (1, 2)), 6) + 0.0 AS pq_things, round(avg(sq * rq) FILTER (cls NOT IN (1, 2)), 6) + 0.0 AS pq_stuff FROM z""")
def pq_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.panoptic_summary(metrics.panoptic_quality(_semantic(spark, d), 10), [1, 2])
    return _tidy(out, "pq", "sq", "rq", "pq_things", "pq_stuff")


@query(f"""WITH {_SEM}, {_MIOU}, g AS (SELECT frame, gt_sem, gt_inst, count(*) AS ng FROM sem WHERE gt_inst <> 0 GROUP BY ALL HAVING count(*) > 2),
  p AS (SELECT frame, pred_inst, count(*) AS np FROM sem WHERE pred_inst <> 0 GROUP BY ALL),
  b AS (SELECT frame, gt_sem, gt_inst, pred_inst, count(*) AS n FROM sem WHERE gt_inst <> 0 AND pred_inst <> 0 GROUP BY ALL),
  a AS (SELECT sum(n / ng * n / (np + ng - n)) / (SELECT count(*) FROM g WHERE gt_sem IN (1, 2)) AS aq FROM b JOIN g USING (frame, gt_sem, gt_inst) JOIN p USING (frame, pred_inst)),
  i AS (SELECT avg(n / (np + ng - n)) AS miou FROM c)
  SELECT round(aq, 6) + 0.0 AS aq, round(miou, 6) + 0.0 AS miou, round(sqrt(aq * miou), 6) + 0.0 AS pq4d FROM a, i""")
def pq4d(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.panoptic_4d(_semantic(spark, d), 2, [1, 2], "frame"), "aq", "miou", "pq4d")


@query(f"""WITH {_INST} SELECT pred, {", ".join(f"round({f}({a}), 6) + 0.0 AS {n}_{a}" for a in "xyz" for n, f in (("lo", "min"), ("hi", "max"), ("c", "avg")))},
  count(*) AS n FROM inst GROUP BY pred""")
def instance_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(metrics.boxes(_instances(spark, d), "pred"), *(f"{n}_{a}" for a in "xyz" for n in ("lo", "hi", "c")))


@query(f"WITH {_INST}, f AS (SELECT frame, avg((pred = gt * 10)::INT) AS m FROM inst GROUP BY frame) SELECT round(avg(m), 6) + 0.0 AS mean FROM f")
def sequence_average(spark: SparkSession, d: str) -> DataFrame:
    per = _instances(spark, d).groupBy("frame").agg(F.avg((F.col("pred") == F.col("gt") * 10).cast("int")).alias("m"))
    return per.agg(tidy(F.avg("m")).alias("mean"))


# --- masks and merging -------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY logit DESC, query) AS r FROM scores)
  SELECT point_id, CASE WHEN 1 / (1 + exp(-logit)) >= 0.7 THEN query ELSE -1 END AS query FROM k WHERE r = 1""")
def mask_assign(spark: SparkSession, d: str) -> DataFrame:
    return masks.assigned(fx.mask_scores(spark, d), 0.7)


@query(f"""WITH {fx.SCORES}, k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY logit DESC, query) AS r FROM scores),
  b AS (SELECT point_id, CASE WHEN logit >= 0 THEN query ELSE -1 END AS query FROM k WHERE r = 1),
  ok AS (SELECT query FROM b JOIN (SELECT query, count(*) AS mask FROM scores WHERE logit >= 0 GROUP BY query) USING (query) GROUP BY query, mask HAVING count(*) >= 0.2 * mask)
  SELECT point_id, CASE WHEN query IN (FROM ok) THEN query ELSE -1 END AS query FROM b""")
def mask_assign_area(spark: SparkSession, d: str) -> DataFrame:
    return masks.assigned(fx.mask_scores(spark, d), 0.5, 0.2)


@query(f"WITH {fx.SCORES} SELECT point_id, query, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY point_id), 6) + 0.0 AS p FROM scores")
def query_softmax(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(masks.softmax(fx.mask_scores(spark, d)).select("point_id", "query", "p"), "p")


@query(f"""WITH {fx.SCORES}, s AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM scores), q AS (SELECT query, sum(p) AS sp, sum(ln(1 + exp(logit))) AS ss, count(*) AS n FROM s GROUP BY query),
  t AS (SELECT label AS target, count(DISTINCT point_id) AS st FROM s GROUP BY label), o AS (SELECT query, label AS target, sum(p) AS spt, sum(logit) AS slt FROM s GROUP BY ALL)
  SELECT query, target, round(1 - (2 * spt + 1) / (sp + st + 1), 6) + 0.0 AS dice, round((ss - slt) / n, 6) + 0.0 AS ce FROM o JOIN q USING (query) JOIN t USING (target)""")
def mask_costs(spark: SparkSession, d: str) -> DataFrame:
    scores = fx.mask_scores(spark, d)
    targets = scores.select("point_id", F.col("label").alias("target")).distinct()
    return _tidy(masks.pair_costs(scores.drop("label"), targets), "dice", "ce")


@query(f"""WITH {fx.SCORES}, s AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY point_id) AS p FROM scores),
  e AS (SELECT query, point_id, (label = query)::INT AS fg, CASE WHEN label = query THEN 1 - p ELSE p END AS err FROM s),
  c AS (SELECT *, sum(fg) OVER (PARTITION BY query) AS size, sum(fg) OVER w AS hit, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY query ORDER BY err DESC, point_id)),
  j AS (SELECT *, 1 - (size - hit) / (size + k - hit) AS j FROM c WHERE size > 0),
  g AS (SELECT query, err * (j - coalesce(lag(j) OVER (PARTITION BY query ORDER BY k), 0)) AS part FROM j) SELECT query, round(sum(part), 6) + 0.0 AS loss FROM g GROUP BY query""")
def lovasz(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(masks.lovasz(fx.mask_scores(spark, d), "label"), "loss")


@query(f"WITH {fx.RASTER} SELECT label, min(u) AS x, min(v) AS y, max(u) - min(u) + 1 AS w, max(v) - min(v) + 1 AS h, count(*) AS area FROM raster GROUP BY label")
def mask_bbox(spark: SparkSession, d: str) -> DataFrame:
    return masks.mask_boxes(fx.raster(spark, d))


@query()
def hungarian(spark: SparkSession, d: str) -> DataFrame:
    """An assignment has no SQL; tests hold it against all permutations."""
    scores = fx.mask_scores(spark, d)
    targets = scores.select("point_id", F.col("label").alias("target")).distinct()
    costs = masks.pair_costs(scores.drop("label"), targets).select(F.lit(0).alias("sample"), "query", "target", (5 * F.col("dice") + 2 * F.col("ce")).alias("cost"))
    return masks.matched(costs, "sample")


_OV = f"""WITH {_INST}, o AS (SELECT gt AS label, x, y, z FROM inst WHERE point_id % 2 = 0 AND gt <> 0), n AS (SELECT pred AS label, x, y, z FROM inst WHERE point_id % 2 = 1 AND pred <> 0),
  box AS (SELECT label AS old, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM o GROUP BY label),
  pairs AS (SELECT old, label AS new, count(*) AS inside FROM n JOIN box ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz GROUP BY ALL),
  vo AS (SELECT DISTINCT label AS old, unnest([x, y, z]) AS v FROM o), vn AS (SELECT DISTINCT label AS new, unnest([x, y, z]) AS v FROM n),
  tot AS (SELECT old, new, count(DISTINCT v) AS d FROM (SELECT old, new, v FROM pairs JOIN vo USING (old) UNION ALL SELECT old, new, v FROM pairs JOIN vn USING (new)) GROUP BY ALL),
  iou AS (SELECT old, new, inside, inside / d AS pseudo_iou FROM pairs JOIN tot USING (old, new))"""


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    p = _instances(spark, d)
    old = p.where("point_id % 2 = 0").select(F.col("gt").alias("label"), *"xyz")
    return merge.chunk_overlap(old, p.where("point_id % 2 = 1").select(F.col("pred").alias("label"), *"xyz"), 0.1)


@query(_OV + " SELECT old, new, inside, round(pseudo_iou, 6) + 0.0 AS pseudo_iou FROM iou")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _tidy(_overlap(spark, d), "pseudo_iou")


@query(_OV + " SELECT new, arg_max(old, (pseudo_iou, -old)) AS old FROM iou WHERE pseudo_iou > 0.01 GROUP BY new")
def merge_assign(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_assignment(_overlap(spark, d))


@query()
def merge_map(spark: SparkSession, d: str) -> DataFrame:
    """A fold whose order decides; tests hold it against a small case."""
    p = _instances(spark, d).select((F.col("point_id") % 2).alias("map_id"), F.col("frame").alias("chunk"), "point_id", *"xyz", F.col("gt").alias("label"))
    return merge.merge_map(p)


@query(f"""WITH {_TABLE}, u AS (SELECT gt FROM inst WHERE gt <> 0 AND pred = 0 AND gt NOT IN (SELECT gt FROM pair WHERE iou >= 0.55) GROUP BY gt HAVING count(*) >= 5)
  SELECT point_id, CASE WHEN pred <> 0 THEN pred WHEN gt IN (FROM u) THEN -gt ELSE 0 END AS label FROM inst""")
def label_refresh(spark: SparkSession, d: str) -> DataFrame:
    p = _instances(spark, d)
    return merge.refreshed_labels(p, metrics.matches(metrics.iou_pairs(metrics.contingency(p)), 0.55), 5)
