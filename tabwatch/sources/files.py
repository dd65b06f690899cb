"""Sources and sinks (A1-A11): delimited files, split tables, reports, event tables, request logs.

Reads always take an explicit schema (no inference pass over the data) and validate
required columns on the driver (no job). Writes are plain DataFrame writes; appends are
idempotent per batch when the caller supplies deterministic ids.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwatch.operators.clean import find_target_column, validate_columns
from tabwatch.spec import TARGET_CANDIDATES


def read_delimited(spark: SparkSession, path: str, columns, tag: str | None = None, tag_col: str = "source_tag",
                   sep: str = ";", required=None) -> DataFrame:
    """A1: header CSV with ``sep``; every column read as string (coerce later, B3); literal source tag."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    df = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)
    validate_columns(df, required or columns)
    return df.withColumn(tag_col, F.lit(tag)) if tag is not None else df


def write_delimited(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def union_sources(*frames: DataFrame) -> DataFrame:
    """A2: outer union of columns (missing columns are NULL) = UNION ALL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, path: str, features, target: str, split_col: str = "split", fmt: str = "parquet") -> None:
    """A4: features + target of every split, partitioned by split (one directory per split)."""
    (df.select(*features, target, split_col).write.mode("overwrite").partitionBy(split_col).format(fmt)
     .save(path))


def read_split(spark: SparkSession, path: str, split: str, features, target: str | None = None,
               split_col: str = "split") -> DataFrame:
    """A3: one split back; the target must exist (K8 finds it), features selected, target as int.

    The split filter prunes partitions (only that directory is listed and read).
    """
    df = spark.read.parquet(path).where(F.col(split_col) == split)
    tgt = target or find_target_column(df, TARGET_CANDIDATES)
    validate_columns(df, list(features) + [tgt])
    return df.select(*features, F.col(tgt).cast("int").alias(tgt))


def write_report(report: DataFrame, path: str) -> None:
    """A5: a report frame (one or a few rows, nested structs / maps) as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A5: read with a fixed schema; a missing report is one empty row (``{}``), never an error."""
    try:
        df = spark.read.schema(schema).json(path)
        df.limit(1).collect()
        return df
    except Exception as exc:  # noqa: BLE001  (Spark raises AnalysisException for a missing path)
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        return spark.createDataFrame([tuple(None for _ in schema.fields)], loose)


def report_to_json(report: DataFrame, name: str = "report") -> DataFrame:
    """Nested report row -> one JSON text column (the ``report`` column of monitoring_runs)."""
    return report.select(F.to_json(F.struct(*report.columns)).alias(name))


def recent_features(events: DataFrame, asof, days: int = 30, limit: int | None = None, ts: str = "created_at",
                    features: str = "features", tie=("prediction_id",)) -> DataFrame:
    """Events of the last ``days`` before ``asof``: all, or the newest ``limit`` (TakeOrderedAndProject).

    ``asof`` is a parameter (not now()), so reruns are reproducible. The features stay JSON text;
    ``expand_json_features`` turns them into rows.
    """
    lo = F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    sel = events.where((F.col(ts) >= lo) & (F.col(ts) <= F.lit(asof).cast("timestamp_ntz")))
    return sel if limit is None else sel.orderBy(F.desc(ts), *[F.asc(t) for t in tie]).limit(limit)


PREDICTION_EVENTS_SCHEMA = T.StructType([
    T.StructField("prediction_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("request_id", T.StringType(), True),
    T.StructField("model_name", T.StringType(), False),
    T.StructField("model_version", T.StringType(), True),
    T.StructField("model_alias", T.StringType(), True),
    T.StructField("predicted_class", T.StringType(), False),
    T.StructField("features", T.StringType(), False),
    T.StructField("probabilities", T.StringType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
    T.StructField("actual_class", T.StringType(), True),
    T.StructField("feedback_at", T.TimestampNTZType(), True),
    T.StructField("feedback_comment", T.StringType(), True),
    T.StructField("is_correct", T.BooleanType(), True),
])


def to_prediction_events(df: DataFrame) -> DataFrame:
    """Conform a scored frame to the prediction_events schema (missing columns NULL, JSON as text)."""
    cols = []
    for f in PREDICTION_EVENTS_SCHEMA.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in ("features", "probabilities") and not isinstance(df.schema[f.name].dataType, T.StringType):
                c = F.to_json(c)
            cols.append(c.cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append_predictions(df: DataFrame, path: str, partition_by=None) -> None:
    """Append a batch of prediction events (deterministic ids make retries detectable)."""
    w = to_prediction_events(df).write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


MONITORING_RUNS_SCHEMA = T.StructType([
    T.StructField("monitoring_run_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("sample_size", T.LongType(), False),
    T.StructField("drift_ratio", T.DoubleType(), True),
    T.StructField("drift_detected", T.BooleanType(), False),
    T.StructField("labeled_sample_size", T.LongType(), False),
    T.StructField("rolling_accuracy", T.DoubleType(), True),
    T.StructField("rolling_f1_weighted", T.DoubleType(), True),
    T.StructField("retraining_required", T.BooleanType(), False),
    T.StructField("reason", T.StringType(), True),
    T.StructField("report", T.StringType(), False),
])


def _run_defaults() -> dict:
    return {"sample_size": F.lit(0).cast("long"), "drift_detected": F.lit(False),
            "labeled_sample_size": F.lit(0).cast("long"), "retraining_required": F.lit(False),
            "report": F.lit("{}")}


def monitoring_run_row(report: DataFrame, run_id, created_at, kind: str) -> DataFrame:
    """One monitoring_runs row from a drift or a performance report; absent columns take defaults.

    drift: sample_size = current_samples, retraining iff drift_detected, reason drift_ratio=%.3f.
    performance: retraining iff performance_degraded, reason rolling_accuracy=%.3f.
    """
    r = report
    if kind == "drift":
        flag = F.col("drift_detected")
        reason = F.when(flag, F.concat(F.lit("drift_ratio="), F.format_string("%.3f", F.col("drift_ratio"))))
        vals = {"sample_size": F.col("current_samples").cast("long"), "drift_ratio": F.col("drift_ratio"),
                "drift_detected": flag}
    elif kind == "performance":
        flag = F.coalesce(F.col("performance_degraded"), F.lit(False))
        reason = F.when(flag & F.col("rolling_accuracy").isNotNull(),
                        F.concat(F.lit("rolling_accuracy="), F.format_string("%.3f", F.col("rolling_accuracy"))))
        vals = {"labeled_sample_size": F.col("labeled_sample_size").cast("long"),
                "rolling_accuracy": F.col("rolling_accuracy"), "rolling_f1_weighted": F.col("rolling_f1_weighted")}
    else:
        raise ValueError(f"unknown report kind {kind!r}")
    vals.update({"retraining_required": flag, "reason": F.coalesce(reason, F.lit("none")),
                 "report": F.to_json(F.struct(*r.columns)),
                 "monitoring_run_id": F.lit(run_id), "created_at": F.lit(created_at).cast("timestamp_ntz")})
    cols = []
    for f in MONITORING_RUNS_SCHEMA.fields:
        c = vals.get(f.name, _run_defaults().get(f.name, F.lit(None)))
        cols.append(c.cast(f.dataType).alias(f.name))
    return r.select(*cols)


def append_monitoring_run(row: DataFrame, path: str) -> None:
    """Append one run row."""
    row.write.mode("append").parquet(path)


def save_params(params: DataFrame, path: str) -> None:
    """The fitted preparation params table (one row per feature)."""
    params.coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


MODEL_MANIFEST = "family string, class string, params string, features array<string>, labels array<double>, format int"


def save_model(spark: SparkSession, model, path: str, family: str, params: dict, features, labels) -> None:
    """A fitted model of any family and its manifest row, which names the class that loads it."""
    model.write().overwrite().save(f"{path}/model")
    row = (family, type(model).__name__, json.dumps(params, sort_keys=True), list(features), [float(x) for x in labels], 1)
    # the manifest is written last: a model without one was not saved whole
    spark.createDataFrame([row], MODEL_MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_model(spark: SparkSession, path: str):
    """(model, manifest as a dict), the loader picked by the manifest's class."""
    from pyspark.ml import classification

    row = spark.read.schema(MODEL_MANIFEST).json(f"{path}/manifest").first().asDict()
    if row["format"] != 1 or not row["class"].endswith("Model"):
        raise ValueError(f"unknown model manifest: {row}")
    return getattr(classification, row["class"]).load(f"{path}/model"), {**row, "params": json.loads(row["params"])}


def read_if_written(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table, or no rows where nothing has been written yet."""
    try:
        df = spark.read.schema(schema).parquet(path)
        df.limit(1).collect()
        return df
    except Exception as exc:  # noqa: BLE001  (Spark raises AnalysisException for a missing path)
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def write_cv_results(results: DataFrame, path: str, rank_col: str = "rank_test_f1_macro") -> None:
    """A10: CV results sorted by rank (range-partitioned sort, no single-task ordering)."""
    results.orderBy(rank_col).write.mode("overwrite").parquet(path)


REQUEST_LOG_SCHEMA = T.StructType([
    T.StructField("asctime", T.StringType(), True),
    T.StructField("levelname", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
    T.StructField("request_id", T.StringType(), True),
    T.StructField("method", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("status_code", T.IntegerType(), True),
    T.StructField("duration_ms", T.DoubleType(), True),
])


def parse_request_log(raw: DataFrame) -> DataFrame:
    """A11 (shared by batch and stream): typed request log; bad lines keep NULLs, never fail the job.

    Times are written "2024-01-31 12:00:00,123" (a comma or a point before the fraction).
    """
    at = F.regexp_replace("asctime", ",", ".").try_cast("timestamp_ntz")
    return raw.select(at.alias("ts"), "request_id", "method", "path",
                      "status_code", "duration_ms")


def ingest_json_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line -> typed request log (input of the request metrics)."""
    return parse_request_log(spark.read.schema(REQUEST_LOG_SCHEMA).json(path))
