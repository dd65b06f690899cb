"""Bindings for sources and sinks (A1-A8, A11). Files are written under the session's shared
checkpoint folder (spark.checkpoint.dir), derived from the driver's tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import clean as B
from tabwatch.operators import prepare as P
from tabwatch.operators.score import deterministic_id
from tabwatch.plans.catalog import r6, register, table
from tabwatch.plans.q_prepare import _SPLIT_SQL
from tabwatch.session import scratch_path
from tabwatch.sources import files as A

_CUST = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@register("read_delimited", f"SELECT {', '.join(_CUST)}, 'customer' AS source_tag FROM customer")
def q_read_delimited(spark, sf):
    path = scratch_path(spark, "customer-csv")
    A.write_delimited(table(spark, sf, "customer"), path)
    raw = A.read_delimited(spark, path, _CUST, tag="customer")
    typed = B.coerce_numeric(raw, ["c_custkey", "c_nationkey", "c_acctbal"])
    return typed.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                        F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment", "source_tag")


@register("union_sources", """
SELECT c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS source_tag FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def q_union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
                                            F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source_tag"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"),
                                            F.lit("supplier").alias("source_tag"))
    return A.union_sources(c, s)


_FEATS = ["o_totalprice", "o_custkey"]
_TARGET = "priority_class"


def _written_splits(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", *_FEATS,
        F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(1)).cast("int").alias(_TARGET))
    s = P.stratified_split(o, "o_orderpriority", ["o_orderkey"])
    path = scratch_path(spark, "splits")
    A.write_splits(s, path, _FEATS, _TARGET)
    return path


_SPLITS_SQL = f"""(SELECT o.o_totalprice, o.o_custkey, CAST(split_part(o.o_orderpriority, '-', 1) AS INTEGER) AS {_TARGET},
  s.split FROM ({_SPLIT_SQL}) s JOIN orders o USING (o_orderkey))"""


@register("write_splits", f"SELECT * FROM {_SPLITS_SQL}")
def q_write_splits(spark, sf):
    path = _written_splits(spark, sf)
    return spark.read.parquet(path).select(*_FEATS, _TARGET, "split")


@register("read_split", f"SELECT o_totalprice, o_custkey, {_TARGET} FROM {_SPLITS_SQL} WHERE split = 'test'")
def q_read_split(spark, sf):
    path = _written_splits(spark, sf)
    return A.read_split(spark, path, "test", _FEATS, target=_TARGET)


def _drift_report(spark, sf):
    from tabwatch.plans.q_monitor import events_drift_report
    return events_drift_report(spark, sf, with_details=True)


@register("report_roundtrip")
def q_report_roundtrip(spark, sf):
    rep = _drift_report(spark, sf)
    path = scratch_path(spark, "drift-report")
    A.write_report(rep, path)
    back = A.read_report(spark, path, rep.schema)
    missing = A.read_report(spark, path + "-missing", rep.schema)
    return back.unionByName(missing)


_ASOF = "2024-01-25 00:00:00"


def prediction_events(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(deterministic_id(F.lit("evt"), "event_id").alias("prediction_id"), F.col("ts").alias("created_at"),
                     F.col("event_id").cast("string").alias("request_id"), F.lit("classifier").alias("model_name"),
                     F.lit("1").alias("model_version"), F.lit("champion").alias("model_alias"),
                     (F.col("user_id") % 3).cast("string").alias("predicted_class"),
                     F.col("props").alias("features"), F.col("value").alias("latency_ms"))


def _uuid_sql(h: str) -> str:
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


_PE_SQL = f"""(SELECT {_uuid_sql("md5('evt|' || CAST(event_id AS VARCHAR))")} AS prediction_id, ts AS created_at,
  CAST(event_id AS VARCHAR) AS request_id, 'classifier' AS model_name, CAST(user_id % 3 AS VARCHAR) AS predicted_class,
  props AS features, value AS latency_ms FROM events)"""


@register("recent_features", f"""
WITH top AS (SELECT * FROM {_PE_SQL} WHERE created_at >= TIMESTAMP '{_ASOF}' - INTERVAL 10 DAY
             AND created_at <= TIMESTAMP '{_ASOF}' ORDER BY created_at DESC, prediction_id LIMIT 2000)
SELECT prediction_id, created_at, je.key AS feature, CAST(je.value AS DOUBLE) AS value FROM top, json_each(features) je""")
def q_recent_features(spark, sf):
    top = A.recent_features(prediction_events(spark, sf), _ASOF, days=10, limit=2000)
    return B.expand_json_features(top, "features", ids=["prediction_id", "created_at"])


@register("append_predictions", f"SELECT * FROM {_PE_SQL}")
def q_append_predictions(spark, sf):
    path = scratch_path(spark, "prediction-events")
    A.append_predictions(prediction_events(spark, sf), path)
    back = spark.read.schema(A.PREDICTION_EVENTS_SCHEMA).parquet(path)
    return back.select("prediction_id", "created_at", "request_id", "model_name", "predicted_class", "features",
                       "latency_ms")


@register("append_monitoring_run")
def q_append_monitoring_run(spark, sf):
    from tabwatch.plans.q_monitor import performance
    path = scratch_path(spark, "monitoring-runs")
    drift = _drift_report(spark, sf)
    A.append_monitoring_run(A.monitoring_run_row(drift, "drift-1", "2024-01-31 00:00:00", "drift"), path)
    A.append_monitoring_run(A.monitoring_run_row(performance(spark, sf), "perf-1", "2024-01-31 00:05:00",
                                                 "performance"), path)
    return spark.read.schema(A.MONITORING_RUNS_SCHEMA).parquet(path)


@register("ingest_json_log", """
SELECT strptime(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%f') AS ts, CAST(event_id AS VARCHAR) AS request_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, round(value * 10.0, 6) AS duration_ms FROM events""")
def q_ingest_json_log(spark, sf):
    from tabwatch.plans.q_metrics import request_log
    log = request_log(spark, sf)
    lines = log.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSSSSS").alias("asctime"), F.lit("INFO").alias("levelname"),
                       F.lit("app").alias("name"),
                       F.lit("request_completed").alias("message"), F.col("request_id").cast("string").alias("request_id"),
                       "method", "path", "status_code", "duration_ms")
    path = scratch_path(spark, "request-log")
    lines.write.mode("overwrite").json(path)
    got = A.ingest_json_log(spark, path)
    return got.select("ts", "request_id", "method", "path", "status_code", r6("duration_ms").alias("duration_ms"))

