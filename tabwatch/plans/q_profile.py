"""Bindings for profiling operators (D1-D16) on lineitem (l_tax NULL when l_orderkey % 17 = 0).

Target for the target-aware profiles: l_linenumber.
"""

from __future__ import annotations

from tabwatch.operators import clean as B
from tabwatch.operators import profile as D
from tabwatch.plans.catalog import LI_FEATURES, LI_SQL, lineitem_frame, r6, register, table

TARGET = "l_linenumber"
_FEATS = ", ".join(LI_FEATURES)
_LONG = f"(SELECT feature, value FROM (UNPIVOT (SELECT {_FEATS} FROM {LI_SQL}) ON {_FEATS} INTO NAME feature VALUE value))"
LI_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
            "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
DUP_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@register("profile_shape", f"SELECT count(*) AS rows, CAST({len(LI_TYPES)} AS BIGINT) AS columns FROM {LI_SQL}")
def q_profile_shape(spark, sf):
    return D.profile_shape(lineitem_frame(spark, sf))


@register("profile_schema", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null FROM {LI_SQL}" for c, t in LI_TYPES.items()))
def q_profile_schema(spark, sf):
    return D.profile_schema(lineitem_frame(spark, sf))


@register("describe_numeric", f"""
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
       round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max
FROM {_LONG} GROUP BY feature""")
def q_describe_numeric(spark, sf):
    d = D.describe_numeric(lineitem_frame(spark, sf), LI_FEATURES)
    return d.select("feature", "count", *[r6(c).alias(c) for c in ("mean", "std")], "min",
                    *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


@register("null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percent FROM {LI_SQL}" for c in LI_TYPES))
def q_null_counts(spark, sf):
    n = D.null_counts(lineitem_frame(spark, sf))
    return n.select("column", "null_count", r6("null_percent").alias("null_percent"))


_DUP_SRC = f"(SELECT {', '.join(DUP_COLS)} FROM lineitem)"


@register("duplicate_count", f"""
SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM {_DUP_SRC}
GROUP BY {', '.join(DUP_COLS)})""")
def q_duplicate_count(spark, sf):
    return D.duplicate_count(table(spark, sf, "lineitem").select(*DUP_COLS))


@register("duplicate_rows", f"""
SELECT {', '.join(DUP_COLS)} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(DUP_COLS)}) AS rn
FROM {_DUP_SRC}) WHERE rn > 1""")
def q_duplicate_rows(spark, sf):
    return B.duplicate_rows(table(spark, sf, "lineitem").select(*DUP_COLS))


@register("value_counts_by_key", f"SELECT {TARGET}, count(*) AS count FROM lineitem GROUP BY 1")
def q_value_counts_by_key(spark, sf):
    return D.value_counts_by_key(table(spark, sf, "lineitem"), TARGET)


@register("value_counts_by_freq", "SELECT l_returnflag, count(*) AS count FROM lineitem "
                                  "WHERE l_returnflag IS NOT NULL GROUP BY 1")
def q_value_counts_by_freq(spark, sf):
    return D.value_counts_by_freq(table(spark, sf, "lineitem"), "l_returnflag")


_MM = f"(SELECT feature, min(value) AS lo, max(value) AS hi FROM {_LONG} GROUP BY feature)"


@register("histogram", f"""
WITH b AS (SELECT l.feature, lo, hi,
           CAST(least(coalesce(floor((value - lo) * 30 / nullif(hi - lo, 0)) + 1, 1), 30) AS INTEGER) AS bin
           FROM {_LONG} l JOIN {_MM} m USING (feature) WHERE value IS NOT NULL)
SELECT feature, bin, round(lo + (bin - 1) * ((hi - lo) / 30), 6) AS bin_lower, round(lo + bin * ((hi - lo) / 30), 6) AS bin_upper,
       count(*) AS count FROM b GROUP BY feature, bin, lo, hi""")
def q_histogram(spark, sf):
    h = D.histogram(lineitem_frame(spark, sf), LI_FEATURES, bins=30)
    return h.select("feature", "bin", r6("bin_lower").alias("bin_lower"), r6("bin_upper").alias("bin_upper"), "count")


def _corr_sql(a: str, b: str) -> str:
    xx = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
    yy = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"round(covar_pop({xx}, {yy}) / nullif(stddev_pop({xx}) * stddev_pop({yy}), 0), 6)"


@register("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {_corr_sql(a, b)} AS corr FROM {LI_SQL}"
    for a in LI_FEATURES for b in LI_FEATURES))
def q_correlation_matrix(spark, sf):
    c = D.correlation_matrix(lineitem_frame(spark, sf), LI_FEATURES)
    return c.select("feature_x", "feature_y", r6("corr").alias("corr"))


@register("target_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, {_corr_sql(a, 'CAST(' + TARGET + ' AS DOUBLE)')} AS corr FROM {LI_SQL}"
    for a in LI_FEATURES))
def q_target_correlation(spark, sf):
    c = D.target_correlation(lineitem_frame(spark, sf), LI_FEATURES, TARGET)
    return c.select("feature", r6("corr").alias("corr"))


_Q = f"""(SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
      quantile_cont(value, 0.75) AS q3 FROM {_LONG} GROUP BY feature)"""
_BOUNDS = f"(SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM {_Q})"


@register("outlier_counts", f"""
SELECT feature, round(lower, 6) AS lower, round(upper, 6) AS upper,
       count(*) FILTER (WHERE value < lower OR value > upper) AS outliers,
       round(count(*) FILTER (WHERE value < lower OR value > upper) * 100.0 / (SELECT count(*) FROM lineitem), 6)
         AS outlier_percent
FROM {_LONG} l JOIN {_BOUNDS} b USING (feature) GROUP BY feature, lower, upper""")
def q_outlier_counts(spark, sf):
    o = D.outlier_counts(lineitem_frame(spark, sf), LI_FEATURES)
    return o.select("feature", r6("lower").alias("lower"), r6("upper").alias("upper"), "outliers",
                    r6("outlier_percent").alias("outlier_percent"))


@register("boxplot_stats", f"""
SELECT feature, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       min(value) FILTER (WHERE value >= lower AND value <= upper) AS whisker_low,
       max(value) FILTER (WHERE value >= lower AND value <= upper) AS whisker_high,
       count(*) FILTER (WHERE value IS NOT NULL AND (value < lower OR value > upper)) AS fliers
FROM {_LONG} l JOIN {_BOUNDS} b USING (feature) GROUP BY feature, q1, med, q3""")
def q_boxplot_stats(spark, sf):
    b = D.boxplot_stats(lineitem_frame(spark, sf), LI_FEATURES)
    return b.select("feature", r6("q1").alias("q1"), r6("median").alias("median"), r6("q3").alias("q3"),
                    "whisker_low", "whisker_high", "fliers")


@register("pair_density", f"""
WITH l AS (SELECT feature, value, {TARGET} FROM (UNPIVOT (SELECT {_FEATS}, {TARGET} FROM {LI_SQL})
           ON {_FEATS} INTO NAME feature VALUE value))
SELECT l.feature, CAST(least(coalesce(floor((value - lo) * 20 / nullif(hi - lo, 0)) + 1, 1), 20) AS INTEGER) AS x_bin,
       {TARGET}, count(*) AS count
FROM l JOIN {_MM} m USING (feature) WHERE value IS NOT NULL AND {TARGET} IS NOT NULL GROUP BY ALL""")
def q_pair_density(spark, sf):
    return D.pair_density(lineitem_frame(spark, sf), LI_FEATURES, TARGET, bins=20)


@register("eda_report", f"""
SELECT 'shape' AS section, 'rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM {LI_SQL}
UNION ALL SELECT 'shape', 'columns', {float(len(LI_TYPES))}
UNION ALL {" UNION ALL ".join(f"SELECT 'null_counts', '{c}', CAST(count(*) - count({c}) AS DOUBLE) FROM {LI_SQL}" for c in LI_TYPES)}
UNION ALL SELECT 'duplicates', 'duplicate_rows', CAST(coalesce(sum(c - 1), 0) AS DOUBLE)
          FROM (SELECT count(*) AS c FROM {LI_SQL} GROUP BY {', '.join(LI_TYPES)})
UNION ALL SELECT 'target_distribution', CAST({TARGET} AS VARCHAR), CAST(count(*) AS DOUBLE) FROM {LI_SQL} GROUP BY {TARGET}
UNION ALL {" UNION ALL ".join(f"SELECT 'target_correlation', '{a}', {_corr_sql(a, 'CAST(' + TARGET + ' AS DOUBLE)')} FROM {LI_SQL}" for a in LI_FEATURES)}
UNION ALL SELECT 'outliers', feature, CAST(count(*) FILTER (WHERE value < lower OR value > upper) AS DOUBLE)
          FROM {_LONG} l JOIN {_BOUNDS} b USING (feature) GROUP BY feature""")
def q_eda_report(spark, sf):
    r = D.eda_report(lineitem_frame(spark, sf), LI_FEATURES, TARGET)
    return r.select("section", "key", r6("value").alias("value"))
