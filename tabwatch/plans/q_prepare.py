"""Bindings for preparation operators (C1-C10) on lineitem / orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import prepare as P
from tabwatch.plans.catalog import LI_FEATURES, LI_KEY, LI_SQL, TRAIN_CUT, lineitem_frame, r6, register, table
from tabwatch.spec import SplitConfig

_FEATS = ", ".join(LI_FEATURES)
_TRAIN_SQL = f"(SELECT * FROM {LI_SQL} WHERE l_shipdate < TIMESTAMP '{TRAIN_CUT} 00:00:00')"


def _train(spark, sf):
    return lineitem_frame(spark, sf).where(F.col("l_shipdate") < F.lit(TRAIN_CUT).cast("timestamp_ntz"))


# ---------------------------------------------------------------- C1 / E1 / K4 on orders
def _quota_sql(src: str, label: str) -> str:
    """Oracle for the two-step largest-remainder quotas (same double arithmetic)."""
    return f"""
c0 AS (SELECT {label}, count(*) AS _c FROM {src} GROUP BY {label}),
c1 AS (SELECT *, sum(_c) OVER () - ceil(CAST(0.15 AS DOUBLE) * sum(_c) OVER ()) AS n_train FROM c0),
c2 AS (SELECT *, _c / sum(_c) OVER () * n_train AS cont FROM c1),
c3 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM c2),
c4 AS (SELECT *, n_train - sum(fl) OVER () AS need,
              row_number() OVER (ORDER BY rem DESC, {label}) AS rr FROM c3),
c5 AS (SELECT {label}, _c, CAST(fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS BIGINT) AS rest FROM c4),
d1 AS (SELECT *, sum(rest) OVER () - ceil(CAST(0.15 AS DOUBLE) / (1 - CAST(0.15 AS DOUBLE))
              * sum(rest) OVER ()) AS n_train2 FROM c5),
d2 AS (SELECT *, rest / sum(rest) OVER () * n_train2 AS cont FROM d1),
d3 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM d2),
d4 AS (SELECT *, n_train2 - sum(fl) OVER () AS need,
              row_number() OVER (ORDER BY rem DESC, {label}) AS rr FROM d3),
quotas AS (SELECT {label}, _c - rest AS q_test,
                  rest - CAST(fl + CASE WHEN rr <= need THEN 1 ELSE 0 END AS BIGINT) AS q_validation FROM d4)"""


_SPLIT_SQL = f"""
WITH {_quota_sql('orders', 'o_orderpriority')},
ranked AS (SELECT o_orderkey, o_orderpriority,
                  row_number() OVER (PARTITION BY o_orderpriority
                                     ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rk
           FROM orders)
SELECT r.o_orderkey, r.o_orderpriority,
       CASE WHEN rk <= q_test THEN 'test' WHEN rk <= q_test + q_validation THEN 'validation' ELSE 'train' END AS split
FROM ranked r JOIN quotas q USING (o_orderpriority)"""


def orders_split(spark, sf, buckets=None):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.stratified_split(o, "o_orderpriority", ["o_orderkey"], SplitConfig(), buckets=buckets)


@register("stratified_split", _SPLIT_SQL)
def q_stratified_split(spark, sf):
    return orders_split(spark, sf).select("o_orderkey", "o_orderpriority", "split")


@register("split_sizes", f"""
WITH s AS ({_SPLIT_SQL})
SELECT o_orderpriority, split, count(*) AS n FROM s GROUP BY ALL""")
def q_split_sizes(spark, sf):
    return q_stratified_split(spark, sf).groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_folds", """
WITH c AS (SELECT o_orderpriority, count(*) AS _c FROM orders GROUP BY 1),
off AS (SELECT o_orderpriority, coalesce(sum(_c) OVER (ORDER BY o_orderpriority
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS coff FROM c),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
      ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rk FROM orders)
SELECT o_orderkey, o_orderpriority, CAST((coff + rk - 1) % 3 AS INTEGER) AS fold FROM r JOIN off USING (o_orderpriority)""")
def q_stratified_folds(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.stratified_folds(o, "o_orderpriority", ["o_orderkey"], k=3, seed=42).select(
        "o_orderkey", "o_orderpriority", "fold")


# ---------------------------------------------------------------- C2-C9 on lineitem
@register("fit_median", f"""
SELECT feature, round(quantile_cont(value, 0.5), 6) AS median
FROM (UNPIVOT {_TRAIN_SQL} ON {_FEATS} INTO NAME feature VALUE value) GROUP BY feature""")
def q_fit_median(spark, sf):
    m = P.fit_median(_train(spark, sf), LI_FEATURES)
    return m.select("feature", r6("median").alias("median"))


def _median_sql():
    return (f"(SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in LI_FEATURES)} FROM {_TRAIN_SQL})")


@register("impute_median", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {', '.join(f'round(coalesce({c}, m_{c}), 6) AS {c}' for c in LI_FEATURES)}
FROM {LI_SQL} t, {_median_sql()} m""")
def q_impute_median(spark, sf):
    med = P.fit_median(_train(spark, sf), LI_FEATURES)
    out = P.impute_median(lineitem_frame(spark, sf), med, LI_FEATURES)
    return out.select(*LI_KEY, *[r6(c).alias(c) for c in LI_FEATURES])


def _imputed_train_sql():
    return (f"(SELECT {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in LI_FEATURES)} "
            f"FROM {_TRAIN_SQL} t, {_median_sql()} m)")


_BOUNDS_SQL = f"""
SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
FROM (UNPIVOT {_imputed_train_sql()} ON {_FEATS} INTO NAME feature VALUE value) GROUP BY feature"""


@register("fit_iqr_bounds", f"""
SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3,
       round(q1 - CAST(1.5 AS DOUBLE) * (q3 - q1), 6) AS lower, round(q3 + CAST(1.5 AS DOUBLE) * (q3 - q1), 6) AS upper
FROM ({_BOUNDS_SQL})""")
def q_fit_iqr_bounds(spark, sf):
    tr = _train(spark, sf)
    med = P.fit_median(tr, LI_FEATURES)
    b = P.fit_iqr_bounds(P.impute_median(tr, med, LI_FEATURES), LI_FEATURES)
    return b.select("feature", *[r6(c).alias(c) for c in ("q1", "q3", "lower", "upper")])


def _bounds_wide_sql():
    parts = []
    for c in LI_FEATURES:
        parts.append(f"max(CASE WHEN feature = '{c}' THEN q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) END) AS lo_{c}")
        parts.append(f"max(CASE WHEN feature = '{c}' THEN q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) END) AS hi_{c}")
    return f"(SELECT {', '.join(parts)} FROM ({_BOUNDS_SQL}))"


@register("clip_iqr", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {', '.join(f'round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, lo_{c}), hi_{c}) END, 6) AS {c}'
                  for c in LI_FEATURES)}
FROM {LI_SQL} t, {_bounds_wide_sql()} b""")
def q_clip_iqr(spark, sf):
    tr = _train(spark, sf)
    med = P.fit_median(tr, LI_FEATURES)
    b = P.fit_iqr_bounds(P.impute_median(tr, med, LI_FEATURES), LI_FEATURES)
    out = P.clip_iqr(lineitem_frame(spark, sf), b, LI_FEATURES)
    return out.select(*LI_KEY, *[r6(c).alias(c) for c in LI_FEATURES])


def _clipped_train_sql():
    return (f"(SELECT {', '.join(f'least(greatest(coalesce({c}, m_{c}), lo_{c}), hi_{c}) AS {c}' for c in LI_FEATURES)} "
            f"FROM {_TRAIN_SQL} t, {_median_sql()} m, {_bounds_wide_sql()} b)")


def _scaler_sql(kind: str) -> str:
    rows = []
    for c in LI_FEATURES:
        if kind == "standard":
            center = f"avg({c})"
            scale = f"CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END"
        else:
            center = f"min({c})"
            scale = f"CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE max({c}) - min({c}) END"
        rows.append(f"SELECT '{c}' AS feature, round({center}, 6) AS center, round({scale}, 6) AS scale "
                    f"FROM {_clipped_train_sql()}")
    return " UNION ALL ".join(rows)


def _fit_scaler(spark, sf, kind):
    tr = _train(spark, sf)
    med = P.fit_median(tr, LI_FEATURES)
    imp = P.impute_median(tr, med, LI_FEATURES)
    b = P.fit_iqr_bounds(imp, LI_FEATURES)
    return P.fit_scaler(P.clip_iqr(imp, b, LI_FEATURES), LI_FEATURES, kind)


@register("scale_standard", _scaler_sql("standard"))
def q_scale_standard(spark, sf):
    return _fit_scaler(spark, sf, "standard").select("feature", r6("center").alias("center"),
                                                    r6("scale").alias("scale"))


@register("scale_minmax", _scaler_sql("minmax"))
def q_scale_minmax(spark, sf):
    return _fit_scaler(spark, sf, "minmax").select("feature", r6("center").alias("center"),
                                                  r6("scale").alias("scale"))


def _params_wide_sql():
    parts = []
    for c in LI_FEATURES:
        parts.append(f"avg({c}) AS mu_{c}")
        parts.append(f"CASE WHEN min({c}) = max({c}) THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}")
    return f"(SELECT {', '.join(parts)} FROM {_clipped_train_sql()})"


_PREPARED_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       {', '.join(f'round((least(greatest(coalesce({c}, m_{c}), lo_{c}), hi_{c}) - mu_{c}) / sd_{c}, 6) AS {c}'
                  for c in LI_FEATURES)}
FROM {LI_SQL} t, {_median_sql()} m, {_bounds_wide_sql()} b, {_params_wide_sql()} s"""


@register("fit_transform_preparation", _PREPARED_SQL)
def q_fit_transform_preparation(spark, sf):
    li = lineitem_frame(spark, sf).withColumn(
        "split", F.when(F.col("l_shipdate") < F.lit(TRAIN_CUT).cast("timestamp_ntz"), "train").otherwise("other"))
    out, _ = P.fit_transform_preparation(li, LI_FEATURES, keep=LI_KEY)
    return out.select(*LI_KEY, *[r6(c).alias(c) for c in LI_FEATURES])


@register("apply_preparation", _PREPARED_SQL)
def q_apply_preparation(spark, sf):
    params = P.fit_preparation(_train(spark, sf), LI_FEATURES)
    out = P.apply_preparation(lineitem_frame(spark, sf), params, LI_FEATURES, keep=LI_KEY)
    return out.select(*LI_KEY, *[r6(c).alias(c) for c in LI_FEATURES])


@register("preparation_report", f"""
WITH raw AS (SELECT o_orderpriority, o_orderstatus FROM orders),
g AS (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM raw GROUP BY ALL),
split AS ({_SPLIT_SQL})
SELECT 'deduplication' AS section, 'rows_before_deduplication' AS key, CAST(sum(c) AS DOUBLE) AS value FROM g
UNION ALL SELECT 'deduplication', 'rows_after_deduplication', CAST(count(*) AS DOUBLE) FROM g
UNION ALL SELECT 'deduplication', 'duplicates_removed', CAST(sum(c - 1) AS DOUBLE) FROM g
UNION ALL SELECT 'null_counts', 'o_orderkey', CAST(count(*) - count(o_orderkey) AS DOUBLE) FROM orders
UNION ALL SELECT 'null_counts', 'o_orderpriority', CAST(count(*) - count(o_orderpriority) AS DOUBLE) FROM orders
UNION ALL SELECT 'label_distribution_full', o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2
UNION ALL SELECT 'label_distribution_' || split, o_orderpriority, CAST(count(*) AS DOUBLE) FROM split GROUP BY 1, 2
UNION ALL SELECT 'shape_rows', split, CAST(count(*) AS DOUBLE) FROM split GROUP BY 2""")
def q_preparation_report(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select("o_orderpriority", "o_orderstatus")
    keyed = o.select("o_orderkey", "o_orderpriority")
    splits = P.stratified_split(keyed, "o_orderpriority", ["o_orderkey"])
    return P.preparation_report(raw, keyed, splits, "o_orderpriority")
