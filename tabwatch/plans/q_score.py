"""Bindings for feedback joins (H3, H4).

predictions = orders (id o_orderkey, class o_custkey % 3 as text, time o_orderdate);
feedback = lineitem rows (id l_orderkey, negative where it is a multiple of 5 so that some feedback has no
prediction, class l_linenumber % 3 as text, time l_shipdate), ties broken by l_linenumber, l_partkey, l_suppkey.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import score as S
from tabwatch.plans.catalog import register, table

PRED_SQL = (f"(SELECT o_orderkey AS prediction_id, o_orderdate AS created_at, "
            f"CAST(o_custkey % 3 AS VARCHAR) AS predicted_class FROM orders)")
FB_SQL = ("(SELECT CASE WHEN l_orderkey % 5 = 0 THEN -l_orderkey ELSE l_orderkey END AS prediction_id, CAST(l_linenumber % 3 AS VARCHAR) AS actual_class, "
          "l_shipdate AS feedback_at, l_returnflag || l_linestatus AS comment, l_linenumber, l_partkey, l_suppkey "
          "FROM lineitem)")
ATTACHED_SQL = f"""(
SELECT p.prediction_id, p.created_at, p.predicted_class, f.actual_class, f.feedback_at,
       f.comment AS feedback_comment,
       CASE WHEN f.actual_class IS NULL THEN NULL ELSE p.predicted_class = f.actual_class END AS is_correct
FROM {PRED_SQL} p LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id
                 ORDER BY feedback_at DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM {FB_SQL})
  WHERE rn = 1) f USING (prediction_id))"""


def predictions(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_orderdate").alias("created_at"),
                    (F.col("o_custkey") % 3).cast("string").alias("predicted_class"))


def feedback(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.col("l_orderkey")
    return li.select(F.when(key % 5 == 0, -key).otherwise(key).alias("prediction_id"),
                     (F.col("l_linenumber") % 3).cast("string").alias("actual_class"),
                     F.col("l_shipdate").alias("feedback_at"),
                     F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("comment"),
                     "l_linenumber", "l_partkey", "l_suppkey")


def attached(spark, sf):
    return S.attach_feedback(predictions(spark, sf), feedback(spark, sf),
                             tie=("l_linenumber", "l_partkey", "l_suppkey"))


@register("attach_feedback", f"SELECT * FROM {ATTACHED_SQL}")
def q_attach_feedback(spark, sf):
    return attached(spark, sf).select("prediction_id", "created_at", "predicted_class", "actual_class",
                                      "feedback_at", "feedback_comment", "is_correct")


@register("unmatched_feedback", f"""
SELECT f.* FROM {FB_SQL} f WHERE NOT EXISTS (SELECT 1 FROM {PRED_SQL} p WHERE p.prediction_id = f.prediction_id)""")
def q_unmatched_feedback(spark, sf):
    return S.unmatched_feedback(predictions(spark, sf), feedback(spark, sf))
