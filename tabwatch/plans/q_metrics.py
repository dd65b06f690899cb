"""Bindings for request metrics and alert rules (J1-J12, J14) on events.

Request log: request_id = event_id, method POST for purchase/signup else GET,
path = '/' || event_type, status 500 for error else 200, duration_ms = value * 10
(value / 100 seconds). Probe samples: target = event_type, success = value <= 400.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import metrics as J
from tabwatch.plans.catalog import r6, register, table
from tabwatch.spec import DEFAULT_ALERT_RULES, LATENCY_BUCKETS


def request_log(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("request_id"), "ts",
                     F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
                     F.concat(F.lit("/"), F.col("event_type")).alias("path"),
                     F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
                     (F.col("value") * 10.0).alias("duration_ms"))


LOG_SQL = """(SELECT event_id AS request_id, ts,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
  '/' || event_type AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  value * 10.0 AS duration_ms FROM events)"""
_STEP = "CAST(ceil(epoch_us(ts) / 1000000.0 / 15) * 15 AS BIGINT)"
_D = "duration_ms / 1000.0"


def _ts(t: str) -> str:
    return f"make_timestamp(CAST({t} AS BIGINT) * 1000000)"


@register("request_counts", f"SELECT method, path, status_code, count(*) AS requests FROM {LOG_SQL} GROUP BY ALL")
def q_request_counts(spark, sf):
    return J.request_counts(request_log(spark, sf))


@register("error_counts", f"SELECT method, path, count(*) AS errors FROM {LOG_SQL} WHERE status_code >= 500 GROUP BY ALL")
def q_error_counts(spark, sf):
    return J.error_counts(request_log(spark, sf))


_HIST_G = (f"(SELECT method, path, {', '.join(f'count(*) FILTER (WHERE {_D} <= {b}) AS b{i}' for i, b in enumerate(LATENCY_BUCKETS))}, "
           f"count(*) AS binf, sum({_D}) AS dsum FROM {LOG_SQL} GROUP BY ALL)")


@register("latency_histogram", " UNION ALL ".join(
    [f"SELECT method, path, round(dsum, 6) AS duration_sum, binf AS duration_count, '{lbl}' AS le, b{i} AS bucket_count "
     f"FROM {_HIST_G}" for i, lbl in enumerate(J.LE_LABELS[:-1])]
    + [f"SELECT method, path, round(dsum, 6), binf, '+Inf', binf FROM {_HIST_G}"]))
def q_latency_histogram(spark, sf):
    h = J.latency_histogram(request_log(spark, sf))
    return h.select("method", "path", r6("duration_sum").alias("duration_sum"), "duration_count", "le", "bucket_count")


def prediction_rows(spark, sf):
    o = table(spark, sf, "orders")
    cls = (F.col("o_custkey") % 3).cast("string")
    return o.select(F.concat(F.lit("model-"), F.col("o_orderpriority")).alias("model_name"),
                    F.when(F.col("o_orderstatus") == "F", cls).alias("prediction"),
                    F.when(F.col("o_orderstatus") == "O", cls).alias("predicted_class"))


@register("prediction_counts", """
SELECT 'model-' || o_orderpriority AS model_name,
  coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 3 AS VARCHAR) END,
           CASE WHEN o_orderstatus = 'O' THEN CAST(o_custkey % 3 AS VARCHAR) END, 'unknown') AS predicted_class,
  count(*) AS predictions FROM orders GROUP BY ALL""")
def q_prediction_counts(spark, sf):
    return J.prediction_counts(prediction_rows(spark, sf))


@register("request_rate", f"""
WITH ps AS (SELECT {_STEP} AS step, count(*) AS requests FROM {LOG_SQL} GROUP BY 1),
ex AS (SELECT step + 15 * j AS t, requests FROM ps, range(0, 20) r(j)),
grid AS (SELECT unnest(generate_series(min(t), max(t), 15)) AS t FROM ex)
SELECT {_ts('t')} AS t, round(coalesce(sum(requests), 0) / 300.0, 6) AS request_rate FROM grid LEFT JOIN ex USING (t) GROUP BY t""")
def q_request_rate(spark, sf):
    r = J.request_rate(request_log(spark, sf))
    return r.select("t", r6("request_rate").alias("request_rate"))


def counter_samples(spark, sf):
    """Scraped cumulative counters per path, reset at midnight: (series, t, value)."""
    log = request_log(spark, sf)
    ps = log.groupBy(F.col("path").alias("series"), J.step_end("ts").alias("_step")).agg(F.count(F.lit(1)).alias("_c"))
    from pyspark.sql import Window
    w = Window.partitionBy("series", F.floor(F.col("_step") / 86400)).orderBy("_step").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return ps.select("series", J.to_ntz(F.col("_step")).alias("t"), F.sum("_c").over(w).cast("double").alias("value"))


@register("counter_increase", f"""
WITH ps AS (SELECT path AS series, {_STEP} AS step, count(*) AS c FROM {LOG_SQL} GROUP BY ALL),
s AS (SELECT series, step, CAST(sum(c) OVER (PARTITION BY series, floor(step / 86400) ORDER BY step
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value FROM ps)
SELECT series, {_ts('step')} AS t, value,
  CASE WHEN lag(value) OVER w IS NULL THEN NULL WHEN value < lag(value) OVER w THEN value
       ELSE value - lag(value) OVER w END AS increase
FROM s WINDOW w AS (PARTITION BY series ORDER BY step)""")
def q_counter_increase(spark, sf):
    return J.counter_increase(counter_samples(spark, sf))


_ERR_SQL = f"""(WITH ex AS (SELECT step + 15 * j AS t, requests, errors FROM
      (SELECT {_STEP} AS step, count(*) AS requests, count(*) FILTER (WHERE status_code >= 500) AS errors
       FROM {LOG_SQL} GROUP BY 1), range(0, 20) r(j)),
  grid AS (SELECT unnest(generate_series(min(t), max(t), 15)) AS t FROM ex),
  w AS (SELECT t, coalesce(sum(requests), 0) / 300.0 AS requests, coalesce(sum(errors), 0) / 300.0 AS errors FROM grid LEFT JOIN ex USING (t) GROUP BY t)
SELECT {_ts('t')} AS t, requests AS request_rate, errors AS error_rate, errors / greatest(requests, 0.001) AS error_ratio FROM w)"""


@register("error_ratio", f"""
SELECT t, round(request_rate, 6) AS request_rate, round(error_rate, 6) AS error_rate,
  round(error_ratio, 6) AS error_ratio, error_ratio > 0.05 AS breach FROM {_ERR_SQL}""")
def q_error_ratio(spark, sf):
    e = J.error_ratio(request_log(spark, sf))
    return e.select("t", *[r6(c).alias(c) for c in ("request_rate", "error_rate", "error_ratio")], "breach")


_NB = len(LATENCY_BUCKETS)
_BOUNDS = "[" + ", ".join(str(float(b)) for b in LATENCY_BUCKETS) + "]"
_P95_SQL = f"""(WITH ps AS (SELECT {_STEP} AS step,
    {', '.join(f'count(*) FILTER (WHERE {_D} <= {b}) AS b{i}' for i, b in enumerate(LATENCY_BUCKETS))}, count(*) AS binf
    FROM {LOG_SQL} GROUP BY 1),
  w AS (SELECT step + 15 * j AS t, {', '.join(f'b{i}' for i in range(_NB))}, binf FROM ps, range(0, 20) r(j)),
  s AS (SELECT t, [{', '.join(f'CAST(sum(b{i}) AS DOUBLE)' for i in range(_NB))}, CAST(sum(binf) AS DOUBLE)] AS cum
        FROM w GROUP BY t),
  x AS (SELECT t, cum, cum[{_NB + 1}] AS total, 0.95 * cum[{_NB + 1}] AS rnk,
        len(list_filter(cum[1:{_NB}], lambda v: v < 0.95 * cum[{_NB + 1}])) AS idx FROM s),
  y AS (SELECT t, total, rnk, idx, CASE WHEN idx = 0 THEN 0.0 ELSE cum[greatest(idx, 1)] END AS below,
        CASE WHEN idx = 0 THEN 0.0 ELSE {_BOUNDS}[greatest(idx, 1)] END AS lower,
        {_BOUNDS}[least(idx + 1, {_NB})] AS upper, cum[idx + 1] AS here FROM x)
SELECT {_ts('t')} AS t, CASE WHEN total = 0 THEN NULL WHEN idx = {_NB} THEN {float(LATENCY_BUCKETS[-1])}
  ELSE lower + (upper - lower) * ((rnk - below) / (here - below)) END AS latency_p95_seconds FROM y)"""


@register("latency_p95_buckets", f"""
SELECT t, round(latency_p95_seconds, 6) AS latency_p95_seconds, latency_p95_seconds > 2.0 AS breach FROM {_P95_SQL}""")
def q_latency_p95_buckets(spark, sf):
    p = J.latency_p95_buckets(request_log(spark, sf))
    return p.select("t", r6("latency_p95_seconds").alias("latency_p95_seconds"), "breach")


@register("latency_p95_exact", f"""
SELECT {_ts('floor(epoch_us(ts) / 1000000.0 / 300) * 300')} AS window_start,
  round(quantile_cont({_D}, 0.95), 6) AS latency_p95_seconds
FROM {LOG_SQL} GROUP BY 1""")
def q_latency_p95_exact(spark, sf):
    p = J.latency_p95_exact(request_log(spark, sf))
    return p.select("window_start", r6("latency_p95_seconds").alias("latency_p95_seconds"))


@register("gauge_max", """
SELECT max(value) AS gauge_max, count(*) AS series FROM (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) WHERE rn = 1""")
def q_gauge_max(spark, sf):
    ev = table(spark, sf, "events")
    return J.gauge_max(ev, series=["user_id"], ts="ts", value="value", tie=["event_id"])


def alert_samples(spark, sf):
    """(metric, series, t, value): error ratio, p95 latency and probe success samples."""
    log = request_log(spark, sf)
    er = J.error_ratio(log).select(F.lit("error_ratio").alias("metric"), F.lit("api").alias("series"), "t",
                                   F.col("error_ratio").alias("value"))
    p95 = J.latency_p95_buckets(log).select(F.lit("latency_p95_seconds").alias("metric"), F.lit("api").alias("series"),
                                            "t", F.col("latency_p95_seconds").alias("value"))
    ev = table(spark, sf, "events")
    probe = ev.select(F.lit("probe_success").alias("metric"), F.col("event_type").alias("series"),
                      F.col("ts").alias("t"), F.when(F.col("value") <= 400, 1.0).otherwise(0.0).alias("value"))
    return er.unionByName(p95).unionByName(probe)


_SAMPLES_SQL = f"""(SELECT 'error_ratio' AS metric, 'api' AS series, t, error_ratio AS value FROM {_ERR_SQL}
UNION ALL SELECT 'latency_p95_seconds', 'api', t, latency_p95_seconds FROM {_P95_SQL}
UNION ALL SELECT 'probe_success', event_type, ts, CASE WHEN value <= 400 THEN 1.0 ELSE 0.0 END FROM events)"""
_RULES_SQL = "(VALUES " + ", ".join(
    f"('{r.name}', '{r.metric}', '{r.op}', {float(r.threshold)}, {int(r.for_seconds)}, '{r.severity}')"
    for r in DEFAULT_ALERT_RULES) + ") rules(rule, metric, op, threshold, for_seconds, severity)"
_COND_SQL = ("CASE op WHEN '==' THEN value = threshold WHEN '!=' THEN value <> threshold WHEN '<' THEN value < threshold "
             "WHEN '<=' THEN value <= threshold WHEN '>' THEN value > threshold ELSE value >= threshold END")


@register("threshold_alerts", f"""
WITH latest AS (SELECT metric, series, arg_max(value, t) AS value, max(t) AS t FROM {_SAMPLES_SQL} GROUP BY ALL)
SELECT rule, metric, series, t, round(value, 6) AS value, severity, coalesce({_COND_SQL}, false) AS firing
FROM latest JOIN {_RULES_SQL} USING (metric)""")
def q_threshold_alerts(spark, sf):
    a = J.threshold_alerts(alert_samples(spark, sf))
    return a.select("rule", "metric", "series", "t", r6("value").alias("value"), "severity", "firing")


@register("alert_for_duration", f"""
WITH j AS (SELECT *, coalesce({_COND_SQL}, false) AS br, epoch_us(t) / 1000000.0 AS s
           FROM {_SAMPLES_SQL} JOIN {_RULES_SQL} USING (metric)),
k AS (SELECT *, CASE WHEN br AND (lag(br) OVER w IS NULL OR NOT lag(br) OVER w OR s - lag(s) OVER w > 15)
                THEN 1 ELSE 0 END AS st FROM j WINDOW w AS (PARTITION BY rule, series ORDER BY s)),
m AS (SELECT *, sum(st) OVER (PARTITION BY rule, series ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS island FROM k),
b AS (SELECT *, min(s) OVER (PARTITION BY rule, series, island) AS first_s,
      min(t) OVER (PARTITION BY rule, series, island) AS island_start FROM m WHERE br)
SELECT rule, series, t, round(value, 6) AS value, island_start,
  CASE WHEN s - first_s >= for_seconds THEN 'firing' ELSE 'pending' END AS state, severity FROM b""")
def q_alert_for_duration(spark, sf):
    a = J.alert_for_duration(alert_samples(spark, sf))
    return a.select("rule", "series", "t", r6("value").alias("value"), "island_start", "state", "severity")


@register("probe_targets", """
SELECT event_type AS target, date_trunc('day', ts) AS window_start,
  round(avg(CASE WHEN value <= 400 THEN 1.0 ELSE 0.0 END), 6) AS uptime, count(*) AS probes
FROM events GROUP BY ALL""")
def q_probe_targets(spark, sf):
    ev = table(spark, sf, "events")
    probes = ev.select(F.col("event_type").alias("target"), "ts", (F.col("value") <= 400).alias("success"))
    p = J.probe_targets(probes)
    return p.select("target", "window_start", r6("uptime").alias("uptime"), "probes")
