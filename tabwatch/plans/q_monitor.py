"""Bindings for drift / performance / retraining (I1-I9) and the flagship drift report.

Drift: events before 2024-01-16 (reference) vs from 2024-01-16 (current) on
value, user_id and the JSON property k. Performance: the attached feedback of q_score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import monitor as M
from tabwatch.plans.catalog import LI_FEATURES, LI_SQL, lineitem_frame, r6, register, table
from tabwatch.plans.q_score import ATTACHED_SQL, attached
from tabwatch.spec import PerformanceConfig

EV_CUT = "2024-01-16"
EV_FEATURES = ["value", "user_id", "k"]


def _events_features(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return ev.select("ts", F.col("value").cast("double").alias("value"),
                     F.col("user_id").cast("double").alias("user_id"), k.alias("k"))


def drift_frames(spark, sf):
    ev = _events_features(spark, sf)
    cut = F.lit(EV_CUT).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut).drop("ts"), ev.where(F.col("ts") >= cut).drop("ts")


EV_SQL = ("(SELECT ts, CAST(value AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS user_id, "
          "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)")


def _ks_sql(ref_sql: str, cur_sql: str, feats) -> str:
    on = ", ".join(feats)
    k = len(feats)
    return f"""
WITH ref AS {ref_sql}, cur AS {cur_sql},
lng AS (SELECT feature, value, 0 AS side FROM (UNPIVOT (SELECT {on} FROM ref) ON {on} INTO NAME feature VALUE value)
        UNION ALL
        SELECT feature, value, 1 AS side FROM (UNPIVOT (SELECT {on} FROM cur) ON {on} INTO NAME feature VALUE value)),
cnt AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS c_ref, count(*) FILTER (WHERE side = 1) AS c_cur
        FROM lng WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL),
cum AS (SELECT feature, sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc,
               sum(c_ref) OVER (PARTITION BY feature) AS n1, sum(c_cur) OVER (PARTITION BY feature) AS n2
        FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ks AS (SELECT feature, max(abs(cr / n1 - cc / n2)) AS d, CAST(any_value(n1) AS BIGINT) AS n_reference,
              CAST(any_value(n2) AS BIGINT) AS n_current FROM cum GROUP BY feature),
lam AS (SELECT *, sqrt(n_reference * n_current / (n_reference + n_current)) * d AS lam FROM ks),
pv AS (SELECT *, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
              lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * lam * lam))), 0.0), 1.0)
              END AS p FROM lam),
det AS (SELECT feature, d AS ks_statistic, n_reference, n_current, p AS p_value,
               coalesce(p < CAST(0.05 AS DOUBLE) / {k} AND d >= CAST(0.10 AS DOUBLE), false) AS drifted,
               abs(p - CAST(0.05 AS DOUBLE) / {k}) <= CAST(0.2 AS DOUBLE) * (CAST(0.05 AS DOUBLE) / {k}) AS p_uncertain
        FROM pv)"""


_EV_REF = f"(SELECT * FROM {EV_SQL} WHERE ts < TIMESTAMP '{EV_CUT} 00:00:00')"
_EV_CUR = f"(SELECT * FROM {EV_SQL} WHERE ts >= TIMESTAMP '{EV_CUT} 00:00:00')"
_KS_EV = _ks_sql(_EV_REF, _EV_CUR, EV_FEATURES)


@register("ks_two_sample", _KS_EV + """
SELECT feature, round(ks_statistic, 6) AS ks_statistic, n_reference, n_current FROM det""")
def q_ks_two_sample(spark, sf):
    ref, cur = drift_frames(spark, sf)
    ks = M.ks_two_sample(ref, cur, EV_FEATURES)
    return ks.select("feature", r6("ks_statistic").alias("ks_statistic"), "n_reference", "n_current")


@register("ks_pvalue", _KS_EV + """
SELECT feature, round(p_value, 6) AS p_value FROM det""")
def q_ks_pvalue(spark, sf):
    ref, cur = drift_frames(spark, sf)
    det = M.drift_details(ref, cur, EV_FEATURES)
    return det.select("feature", r6("p_value").alias("p_value"))


@register("drift_flags", _KS_EV + """
SELECT feature, round(ks_statistic, 6) AS ks_statistic, round(p_value, 6) AS p_value, drifted, p_uncertain FROM det""")
def q_drift_flags(spark, sf):
    ref, cur = drift_frames(spark, sf)
    det = M.drift_details(ref, cur, EV_FEATURES)
    return det.select("feature", r6("ks_statistic").alias("ks_statistic"), r6("p_value").alias("p_value"),
                      "drifted", "p_uncertain")


def _report_sql(ks_sql: str, ref_sql: str, cur_sql: str, k: int) -> str:
    return ks_sql + f"""
SELECT (SELECT count(*) FROM {ref_sql}) AS reference_samples, (SELECT count(*) FROM {cur_sql}) AS current_samples,
       CAST({k} AS BIGINT) AS features_tested, CAST(count(*) FILTER (WHERE drifted) AS BIGINT) AS features_drifted,
       round(count(*) FILTER (WHERE drifted) / CAST({k} AS DOUBLE), 6) AS drift_ratio,
       count(*) FILTER (WHERE drifted) / CAST({k} AS DOUBLE) >= CAST(0.30 AS DOUBLE) AS drift_detected
FROM det"""


_REPORT_COLS = ["reference_samples", "current_samples", "features_tested", "features_drifted", "drift_ratio",
                "drift_detected"]


def events_drift_report(spark, sf, with_details=False):
    ref, cur = drift_frames(spark, sf)
    return M.drift_report(ref, cur, EV_FEATURES, with_details=with_details)


@register("drift_report", _report_sql(_KS_EV, _EV_REF, _EV_CUR, len(EV_FEATURES)))
def q_drift_report(spark, sf):
    rep = events_drift_report(spark, sf)
    return rep.select(*[r6(c).alias(c) if c == "drift_ratio" else c for c in _REPORT_COLS])


@register("drift_gate", f"""
SELECT *, CASE WHEN current_samples < 100 THEN 'insufficient_samples' ELSE 'ok' END AS status
FROM ({_report_sql(_KS_EV, _EV_REF, _EV_CUR, len(EV_FEATURES))})""")
def q_drift_gate(spark, sf):
    return M.drift_gate(q_drift_report(spark, sf))


# lineitem drift: shipped before 1998 vs from 1998 (the flagship report)
LI_CUT = "1998-01-01"
_LI_REF = f"(SELECT * FROM {LI_SQL} WHERE l_shipdate < TIMESTAMP '{LI_CUT} 00:00:00')"
_LI_CUR = f"(SELECT * FROM {LI_SQL} WHERE l_shipdate >= TIMESTAMP '{LI_CUT} 00:00:00')"


def lineitem_drift_frames(spark, sf):
    li = lineitem_frame(spark, sf).select("l_shipdate", *LI_FEATURES)
    cut = F.lit(LI_CUT).cast("timestamp_ntz")
    return li.where(F.col("l_shipdate") < cut).drop("l_shipdate"), li.where(F.col("l_shipdate") >= cut).drop(
        "l_shipdate")


def flagship_drift_report(spark, sf):
    ref, cur = lineitem_drift_frames(spark, sf)
    return M.drift_report(ref, cur, LI_FEATURES, with_details=True)


@register("drift_report_lineitem", _report_sql(_ks_sql(_LI_REF, _LI_CUR, LI_FEATURES), _LI_REF, _LI_CUR,
                                               len(LI_FEATURES)))
def q_drift_report_lineitem(spark, sf):
    ref, cur = lineitem_drift_frames(spark, sf)
    rep = M.drift_report(ref, cur, LI_FEATURES, with_details=False)
    return rep.select(*[r6(c).alias(c) if c == "drift_ratio" else c for c in _REPORT_COLS])


@register("drift_details_lineitem", _ks_sql(_LI_REF, _LI_CUR, LI_FEATURES) + """
SELECT feature, round(ks_statistic, 6) AS ks_statistic, n_reference, n_current, round(p_value, 6) AS p_value,
       drifted FROM det""")
def q_drift_details_lineitem(spark, sf):
    ref, cur = lineitem_drift_frames(spark, sf)
    det = M.drift_details(ref, cur, LI_FEATURES)
    return det.select("feature", r6("ks_statistic").alias("ks_statistic"), "n_reference", "n_current",
                      r6("p_value").alias("p_value"), "drifted")


# ---------------------------------------------------------------- I6-I9
_LATEST_SQL = f"""(SELECT prediction_id, actual_class, predicted_class, feedback_at FROM {ATTACHED_SQL}
WHERE actual_class IS NOT NULL)"""


@register("latest_feedback", f"SELECT * FROM {_LATEST_SQL}")
def q_latest_feedback(spark, sf):
    return M.latest_feedback(attached(spark, sf))


_PERF_SQL = f"""
WITH l AS {_LATEST_SQL},
cm AS (SELECT actual_class AS a, predicted_class AS p, count(*) AS c FROM l GROUP BY ALL),
cls AS (SELECT a AS cl FROM cm UNION SELECT p FROM cm),
st AS (SELECT cl,
         coalesce((SELECT sum(c) FROM cm WHERE a = cl), 0) AS support,
         coalesce((SELECT sum(c) FROM cm WHERE p = cl), 0) AS pred,
         coalesce((SELECT sum(c) FROM cm WHERE a = cl AND p = cl), 0) AS tp FROM cls),
agg AS (SELECT (SELECT count(*) FROM l) AS n, sum(tp) / sum(support) AS acc,
          sum(CASE WHEN support + pred > 0 THEN 2.0 * tp / (support + pred) ELSE 0 END * support) / sum(support) AS f1
        FROM st)
SELECT n AS labeled_sample_size, n >= 50 AS enough_feedback,
       round(CASE WHEN n >= 50 THEN acc END, 6) AS rolling_accuracy,
       round(CASE WHEN n >= 50 THEN f1 END, 6) AS rolling_f1_weighted,
       n >= 50 AND acc < CAST(0.55 AS DOUBLE) AS performance_degraded FROM agg"""


def performance(spark, sf):
    return M.rolling_performance(M.latest_feedback(attached(spark, sf)), config=PerformanceConfig())


@register("rolling_performance", _PERF_SQL)
def q_rolling_performance(spark, sf):
    p = performance(spark, sf)
    return p.select("labeled_sample_size", "enough_feedback", r6("rolling_accuracy").alias("rolling_accuracy"),
                    r6("rolling_f1_weighted").alias("rolling_f1_weighted"), "performance_degraded")


@register("retraining_decision", f"""
WITH d AS ({_report_sql(_KS_EV, _EV_REF, _EV_CUR, len(EV_FEATURES))}), p AS ({_PERF_SQL}),
x AS (SELECT coalesce(d.current_samples, 0) AS cs, coalesce(d.drift_ratio, 0.0) AS dr,
             coalesce(p.labeled_sample_size, 0) AS ls, coalesce(p.rolling_accuracy, 1.0) AS acc FROM d, p),
r AS (SELECT concat_ws(',', CASE WHEN cs >= 100 AND dr >= CAST(0.30 AS DOUBLE) THEN 'drift_ratio=' || printf('%.3f', dr) END,
                            CASE WHEN ls >= 50 AND acc < CAST(0.55 AS DOUBLE) THEN 'rolling_accuracy=' || printf('%.3f', acc) END) AS reason FROM x)
SELECT reason <> '' AS retraining_required, CASE WHEN reason = '' THEN 'none' ELSE reason END AS reason FROM r""")
def q_retraining_decision(spark, sf):
    return M.retraining_decision(q_drift_report(spark, sf), q_rolling_performance(spark, sf))


def monitoring_runs(spark, sf):
    """A run row per day derived from events; some metrics NULL on some days."""
    ev = table(spark, sf, "events")
    day = F.to_date("ts")
    g = ev.groupBy(day.alias("d")).agg(F.max("ts").alias("created_at"), F.avg("value").alias("_avg"),
                                       F.count_if(F.col("event_type") == "purchase").alias("_p"),
                                       F.count(F.lit(1)).alias("_n"))
    dom = F.dayofmonth("d")
    return g.select(F.concat(F.lit("run-"), F.col("d").cast("string")).alias("monitoring_run_id"), "created_at",
                    F.when(dom % 3 != 0, F.col("_avg") / 500.0).alias("drift_ratio"),
                    F.when(dom % 3 != 0, F.col("_avg") > 50.0).alias("drift_detected"),
                    F.when(dom % 2 != 0, F.col("_p") / F.col("_n")).alias("rolling_accuracy"))


_RUNS_SQL = """(SELECT 'run-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS monitoring_run_id, max(ts) AS created_at,
  CASE WHEN day(CAST(ts AS DATE)) % 3 <> 0 THEN avg(value) / 500.0 END AS drift_ratio,
  CASE WHEN day(CAST(ts AS DATE)) % 3 <> 0 THEN avg(value) > 50.0 END AS drift_detected,
  CASE WHEN day(CAST(ts AS DATE)) % 2 <> 0 THEN count(*) FILTER (WHERE event_type = 'purchase') / count(*) END
    AS rolling_accuracy
FROM events GROUP BY CAST(ts AS DATE))"""


@register("latest_non_null", f"""
SELECT round(arg_max(drift_ratio, created_at) FILTER (WHERE drift_ratio IS NOT NULL), 6) AS drift_ratio,
       round(arg_max(rolling_accuracy, created_at) FILTER (WHERE rolling_accuracy IS NOT NULL), 6) AS rolling_accuracy,
       arg_max(drift_detected, created_at) FILTER (WHERE drift_ratio IS NOT NULL) AS drift_detected
FROM {_RUNS_SQL}""")
def q_latest_non_null(spark, sf):
    out = M.latest_non_null(monitoring_runs(spark, sf), companions={"drift_detected": "drift_ratio"})
    return out.select(r6("drift_ratio").alias("drift_ratio"), r6("rolling_accuracy").alias("rolling_accuracy"),
                      "drift_detected")

