"""Structured Streaming twins.

All sinks are file sinks with a checkpoint in the shared checkpoint folder, so a restarted
query resumes exactly where it stopped (executor or driver loss). Watermarks need
TimestampType, so NTZ event times are cast on the way in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabwatch.spec import DEFAULT_ALERT_RULES, EVAL_STEP_SECONDS


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append", partition_by=None, timeout_s: int | None = None) -> None:
    """Process everything available now into a file sink, then stop (exactly-once via checkpoint)."""
    w = df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.trigger(availableNow=True).start(sink_path)
    finished = q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
    if finished is False:
        q.stop()
        raise TimeoutError(f"stream to {sink_path} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def closed(df: DataFrame, col: str, ahead: str, **values) -> DataFrame:
    """A bounded input with one more row: an event time ``ahead`` of the newest one, ``values``, else NULL.

    A stream over it advances its watermark past every real row and so emits all that waits. A
    join drops rows without a key before they count, so they need one (that nothing matches).
    """
    return df.unionByName(_closing_row(df, col, ahead, values))


def _closing_row(df: DataFrame, col: str, ahead: str, values: dict) -> DataFrame:
    last = df.agg((F.max(col).cast("timestamp") + F.expr(f"INTERVAL {ahead}")).cast(df.schema[col].dataType).alias(col)).where(F.col(col).isNotNull())
    return last.select(*[F.col(c) if c == col else F.lit(values.get(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])


def closed_slices(df: DataFrame, key: str, slices: int, col: str, ahead: str, **values) -> DataFrame:
    """``df`` dealt over ``slices`` by the hash of ``key`` (column ``slice``), each closed as ``closed`` does.

    Streams over one slice at a time keep the state of that slice alone; rows of one key, null
    included, are in one slice, so joins and states by key give the same rows.
    """
    own = df.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    return own.unionByName(_closing_row(df, col, ahead, values).select("*", each))


def with_event_time(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """NTZ -> TIMESTAMP (session time zone UTC) so it can carry a watermark."""
    return df.withColumn(out or col, F.col(col).cast("timestamp"))


def score_stream(stream: DataFrame, score_fn, created_at: str = "created_at") -> DataFrame:
    """H2: stateless scoring of a stream; ``ingestion_lag_ms`` = scoring time - event time."""
    scored = score_fn(stream)
    return scored.withColumn("scored_at", F.current_timestamp()).withColumn(
        "ingestion_lag_ms", (F.unix_micros(F.col("scored_at")) - F.unix_micros(F.col(created_at).cast("timestamp"))) / 1000.0)


def write_prediction_events(scored: DataFrame, path: str, checkpoint: str, timeout_s: int | None = None) -> None:
    """H2 into A7: a scored stream as prediction events (14 columns), every event once.

    Each micro-batch overwrites its own folder, named by its batch id, which a restarted query
    gives again to the same input: a batch that was written but not yet committed is replaced.
    """
    from tabwatch.sources.files import to_prediction_events

    def sink(batch: DataFrame, batch_id: int) -> None:
        to_prediction_events(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if q.awaitTermination(timeout_s) is False:
            raise TimeoutError(f"stream to {path} did not finish in {timeout_s}s")
    finally:
        q.stop()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def attach_feedback_stream(predictions: DataFrame, feedback: DataFrame, bound: str = "30 days",
                           delay: str = "1 day", id_col: str = "prediction_id", created_at: str = "created_at",
                           at: str = "feedback_at") -> DataFrame:
    """H5: stream-stream LEFT OUTER join on the id within +-bound of the prediction time.

    Watermarks bound the join state; a prediction without feedback inside the bound is
    emitted with NULLs once the watermark passes. Feedback outside the bound is not joined
    here: for unbounded delays append both streams and resolve with the batch read-time join.
    """
    p = with_event_time(predictions, created_at).withWatermark(created_at, delay).alias("p")
    f = with_event_time(feedback, at).withWatermark(at, delay).withColumnRenamed(id_col, "_fid").alias("f")
    cond = ((F.col(f"p.{id_col}") == F.col("f._fid"))
            & (F.col(f"f.{at}") >= F.col(f"p.{created_at}") - F.expr(f"INTERVAL {bound}"))
            & (F.col(f"f.{at}") <= F.col(f"p.{created_at}") + F.expr(f"INTERVAL {bound}")))
    return p.join(f, cond, "leftOuter").drop("_fid")


def request_metrics_stream(log: DataFrame, window: str = "5 minutes", delay: str = "10 minutes",
                           ts: str = "ts") -> DataFrame:
    """Per tumbling window and (method, path): requests, errors, duration sum; late data
    within the watermark is counted, duplicates by request_id inside the watermark dropped."""
    s = with_event_time(log, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["request_id"])
    g = s.groupBy(F.window(F.col(ts), window).alias("w"), "method", "path").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.sum(F.col("duration_ms") / 1000.0).alias("duration_sum"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "method", "path", "requests",
                    "errors", "duration_sum")


ALERT_STATE_SCHEMA = "island_start BIGINT, last_t BIGINT, last_breach BOOLEAN, waiting STRING"
ALERT_OUT_SCHEMA = ("rule STRING, series STRING, t TIMESTAMP, value DOUBLE, island_start TIMESTAMP, "
                    "state STRING, severity STRING")
_COLUMNS = ["rule", "series", "t", "value", "island_start", "state", "severity"]


def _alert_fn(rules, step: int):
    """State of one (rule, series): the open island, the last sample, and the samples that wait for
    the watermark, as JSON. Samples advance the island in time order once the watermark has passed
    them, so that one that arrives late, but not too late, takes its place."""
    by_name = {r.name: (r.op, r.threshold, r.for_seconds, r.severity) for r in rules}

    def breaches(op: str, value, threshold: float) -> bool:
        if value is None:
            return False
        return {"==": value == threshold, "!=": value != threshold, "<": value < threshold, "<=": value <= threshold,
                ">": value > threshold, ">=": value >= threshold}[op]

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        rule, series = key
        op, threshold, hold, severity = by_name[rule]
        island, last, last_breach, waiting = state.get if state.exists else (None, None, None, "[]")
        samples = json.loads(waiting)
        if not state.hasTimedOut:
            for pdf in pdfs:
                at = pdf["t"].astype("datetime64[us]").astype("int64")
                samples += [[t, None if pd.isna(v) else float(v)] for t, v in zip(at.tolist(), pdf["value"].tolist())]
        watermark = state.getCurrentWatermarkMs() * 1000
        samples.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0.0))
        passed = [x for x in samples if x[0] <= watermark]
        samples = samples[len(passed):]
        out = []
        for t, value in passed:
            breach = breaches(op, value, threshold)
            if breach:
                if island is None or not last_breach or t - last > step * 1_000_000:
                    island = t
                out.append((rule, series, pd.Timestamp(t, unit="us"), value, pd.Timestamp(island, unit="us"),
                            "firing" if t - island >= hold * 1_000_000 else "pending", severity))
            else:
                island = None
            last, last_breach = t, breach
        if samples:
            wake = samples[0][0] // 1000 + 1
        elif last is not None and last // 1000 + 3_600_000 > watermark // 1000:
            wake = last // 1000 + 3_600_000  # idle keys are dropped an hour past the watermark
        else:
            wake = None
        if wake is None:
            state.remove()
        else:
            state.update((island, last, last_breach, json.dumps(samples)))
            state.setTimeoutTimestamp(max(wake, watermark // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return fn


def alert_state_stream(samples: DataFrame, rules=DEFAULT_ALERT_RULES, delay: str = "10 minutes",
                       step: int = EVAL_STEP_SECONDS) -> DataFrame:
    """Live pending/firing states per (rule, series), the streaming twin of J12.

    samples: (metric, series, t, value) stream. Rules are joined as a literal table. Samples wait
    until the watermark has passed them (``delay`` after the newest one), so late ones count; an
    event-time timeout wakes waiting keys and drops idle ones an hour past the watermark.
    """
    spark = samples.sparkSession
    from tabwatch.operators.metrics import rules_frame
    s = with_event_time(samples, "t").withWatermark("t", delay)
    j = s.join(F.broadcast(rules_frame(spark, rules)).select("rule", "metric"), "metric")
    return j.groupBy("rule", "series").applyInPandasWithState(
        _alert_fn(rules, step), ALERT_OUT_SCHEMA, ALERT_STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)

