"""Bindings for evaluation.

actual = bucket of l_quantity (<=17 -> 0, <=34 -> 1, else 2); predicted = bucket of
l_extendedprice (<=35000 -> 0, <=70000 -> 1, else 2); scores = normalised price ramps.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import evaluate as G
from tabwatch.plans.catalog import r6, register, table
from tabwatch.plans.q_clean import _ramp_sql, ramps
from tabwatch.spec import CLASS_LABELS

LABELS = [0, 1, 2]


def predictions(spark, sf):
    li = ramps(table(spark, sf, "lineitem"))
    actual = F.when(F.col("l_quantity") <= 17, 0).when(F.col("l_quantity") <= 34, 1).otherwise(2)
    pred = F.when(F.col("l_extendedprice") <= 35000, 0).when(F.col("l_extendedprice") <= 70000, 1).otherwise(2)
    return li.select(actual.alias("actual"), pred.alias("predicted"), "scores")


_s = _ramp_sql()
BASE_SQL = f"""(SELECT CASE WHEN l_quantity <= 17 THEN 0 WHEN l_quantity <= 34 THEN 1 ELSE 2 END AS actual,
  CASE WHEN l_extendedprice <= 35000 THEN 0 WHEN l_extendedprice <= 70000 THEN 1 ELSE 2 END AS predicted,
  {_s[0]} AS s0, {_s[1]} AS s1, {_s[2]} AS s2 FROM lineitem)"""

_CM = f"(SELECT actual, predicted, count(*) AS c FROM {BASE_SQL} GROUP BY ALL)"
_STATS = f"""(SELECT cl AS class,
  coalesce((SELECT sum(c) FROM {_CM} x WHERE x.actual = cl AND x.predicted = cl), 0) AS tp,
  coalesce((SELECT sum(c) FROM {_CM} x WHERE x.actual = cl), 0) AS support,
  coalesce((SELECT sum(c) FROM {_CM} x WHERE x.predicted = cl), 0) AS pred
  FROM (SELECT actual AS cl FROM {_CM} UNION SELECT predicted FROM {_CM}))"""
_PRF = f"""(SELECT class, tp, support, pred,
  coalesce(tp / nullif(pred, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
  coalesce(2.0 * tp / nullif(support + pred, 0), 0.0) AS f1 FROM {_STATS})"""
_SUMMARY = f"""(SELECT sum(tp) / sum(support) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro,
  avg(f1) AS f1_macro, sum(precision * support) / sum(support) AS precision_weighted,
  sum(recall * support) / sum(support) AS recall_weighted, sum(f1 * support) / sum(support) AS f1_weighted,
  CAST(sum(support) AS BIGINT) AS n FROM {_PRF})"""


@register("confusion_matrix", f"""
SELECT a AS actual, p AS predicted, coalesce(c, 0) AS count
FROM (SELECT a, p FROM (VALUES (0), (1), (2)) t(a), (VALUES (0), (1), (2)) u(p)) g
LEFT JOIN {_CM} cm ON cm.actual = g.a AND cm.predicted = g.p""")
def q_confusion_matrix(spark, sf):
    return G.confusion_matrix(predictions(spark, sf), "actual", "predicted", LABELS)


@register("accuracy", f"SELECT round(count(*) FILTER (WHERE actual = predicted) / count(*), 6) AS accuracy FROM {BASE_SQL}")
def q_accuracy(spark, sf):
    return G.accuracy(predictions(spark, sf), "actual", "predicted").select(r6("accuracy").alias("accuracy"))


@register("macro_prf", f"""SELECT round(precision_macro, 6) AS precision_macro, round(recall_macro, 6) AS recall_macro,
  round(f1_macro, 6) AS f1_macro FROM {_SUMMARY}""")
def q_macro_prf(spark, sf):
    m = G.macro_prf(predictions(spark, sf), "actual", "predicted")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("weighted_prf", f"""SELECT round(precision_weighted, 6) AS precision_weighted,
  round(recall_weighted, 6) AS recall_weighted, round(f1_weighted, 6) AS f1_weighted FROM {_SUMMARY}""")
def q_weighted_prf(spark, sf):
    m = G.weighted_prf(predictions(spark, sf), "actual", "predicted")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@register("classification_report", f"""
SELECT CASE class WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS "row", round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM {_PRF}
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), n FROM {_SUMMARY}
UNION ALL SELECT 'macro avg', round(precision_macro, 6), round(recall_macro, 6), round(f1_macro, 6), n FROM {_SUMMARY}
UNION ALL SELECT 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6), n
FROM {_SUMMARY}""")
def q_classification_report(spark, sf):
    r = G.classification_report(predictions(spark, sf), "actual", "predicted", LABELS, CLASS_LABELS)
    return r.select("row", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


_OVR = f"""(SELECT 0 AS class, CAST(actual = 0 AS INTEGER) AS y, s0 AS score FROM {BASE_SQL}
  UNION ALL SELECT 1, CAST(actual = 1 AS INTEGER), s1 FROM {BASE_SQL}
  UNION ALL SELECT 2, CAST(actual = 2 AS INTEGER), s2 FROM {BASE_SQL})"""


@register("one_vs_rest_labels", f"SELECT * FROM {_OVR}")
def q_one_vs_rest(spark, sf):
    return G.one_vs_rest(predictions(spark, sf), "actual", "scores", LABELS)


_RT = f"""(SELECT class, score, pos, neg, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, row_number() OVER w AS idx
  FROM (SELECT class, score, sum(y) AS pos, sum(1 - y) AS neg FROM {_OVR} GROUP BY ALL)
  WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_TOT = f"(SELECT class, max(tps) AS P, max(fps) AS N FROM {_RT} GROUP BY class)"


@register("roc_curve", f"""
WITH rt AS {_RT}, tot AS {_TOT},
nb AS (SELECT *, lag(tps) OVER v AS tps_p, lag(fps) OVER v AS fps_p, lead(tps) OVER v AS tps_n,
              lead(fps) OVER v AS fps_n FROM rt WINDOW v AS (PARTITION BY class ORDER BY idx)),
kept AS (SELECT class, score, tps, fps FROM nb WHERE tps_p IS NULL OR tps_n IS NULL
         OR fps_n - 2 * fps + fps_p <> 0 OR tps_n - 2 * tps + tps_p <> 0
         UNION ALL SELECT class, 'inf'::DOUBLE, 0, 0 FROM tot)
SELECT class, score AS threshold, round(fps / N, 6) AS fpr, round(tps / P, 6) AS tpr FROM kept JOIN tot USING (class)""")
def q_roc_curve(spark, sf):
    ovr = G.one_vs_rest(predictions(spark, sf), "actual", "scores", LABELS)
    r = G.roc_curve(ovr)
    return r.select("class", "threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


_AUC = f"""(SELECT class, sum(pos * (N - fps + neg / 2.0)) / (any_value(P) * any_value(N)) AS auc,
  any_value(P) AS positives, any_value(N) AS negatives FROM {_RT} JOIN {_TOT} USING (class) GROUP BY class)"""


@register("roc_auc_per_class", f"""
SELECT class, round(auc, 6) AS auc, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives
FROM {_AUC}""")
def q_roc_auc_per_class(spark, sf):
    ovr = G.one_vs_rest(predictions(spark, sf), "actual", "scores", LABELS)
    return G.roc_auc_per_class(ovr).select("class", r6("auc").alias("auc"), "positives", "negatives")


_WAUC = f"""(SELECT CASE WHEN count(*) FILTER (WHERE positives > 0) = 3 THEN sum(auc * positives) / sum(positives) END
  AS roc_auc_ovr_weighted, count(*) FILTER (WHERE positives > 0) < 3 AS auc_class_absent FROM {_AUC})"""


@register("roc_auc_ovr_weighted", f"""
SELECT round(roc_auc_ovr_weighted, 6) AS roc_auc_ovr_weighted, auc_class_absent FROM {_WAUC}""")
def q_roc_auc_ovr_weighted(spark, sf):
    ovr = G.one_vs_rest(predictions(spark, sf), "actual", "scores", LABELS)
    w = G.roc_auc_ovr_weighted(ovr, LABELS)
    return w.select(r6("roc_auc_ovr_weighted").alias("roc_auc_ovr_weighted"), "auc_class_absent")


_METRICS = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted",
            "f1_weighted", "roc_auc_ovr_weighted"]


@register("classification_metrics", f"""
SELECT {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)}, auc_class_absent FROM {_SUMMARY}, {_WAUC}""")
def q_classification_metrics(spark, sf):
    m = G.classification_metrics(predictions(spark, sf), "actual", "predicted", "scores", LABELS)
    return m.select(*[r6(c).alias(c) for c in _METRICS], "auc_class_absent")
