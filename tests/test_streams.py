"""Batch equals stream (availableNow) for the alert state machine and windowed metrics."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabwatch.operators import metrics as J
from tabwatch.plans.q_metrics import alert_samples, request_log
from tabwatch.plans.q_streams import q_alert_state_stream, q_request_metrics_stream, q_score_stream_events
from tabwatch.sources import files as A
from tabwatch.streaming import streams as ST


def test_alert_stream_equals_batch(spark):
    batch = J.alert_for_duration(alert_samples(spark, SF_SMALL)).select(
        "rule", "series", "t", F.round("value", 6).alias("value"), "island_start", "state", "severity")
    stream = q_alert_state_stream(spark, SF_SMALL)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_request_metrics_stream_equals_batch(spark):
    log = request_log(spark, SF_SMALL)
    batch = log.groupBy(F.window("ts", "5 minutes").start.alias("window_start"), "method", "path").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors"),
        F.round(F.sum(F.col("duration_ms") / 1000.0), 6).alias("duration_sum"))
    stream = q_request_metrics_stream(spark, SF_SMALL)
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def test_score_stream_equals_batch(spark):
    from tabwatch.operators import score as S
    from tabwatch.plans.catalog import LI_FEATURES, LI_KEY
    from tabwatch.plans.q_streams import q_score_stream
    from tabwatch.plans.q_train import _scoring_model
    li, params, model = _scoring_model(spark, SF_SMALL)
    batch = S.score_batch(li, model, params, LI_FEATURES, keep=LI_KEY).select(*LI_KEY, "predicted_class")
    stream = q_score_stream(spark, SF_SMALL).select(*LI_KEY, "predicted_class")
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_feedback_stream_equals_batch(spark):
    from tabwatch.plans.q_score import attached
    from tabwatch.plans.q_streams import q_attach_feedback_stream
    cols = ["prediction_id", "predicted_class", "actual_class", "is_correct"]
    batch, stream = attached(spark, SF_SMALL).select(*cols), q_attach_feedback_stream(spark, SF_SMALL).select(*cols)
    assert batch.exceptAll(stream).count() == 0 and stream.exceptAll(batch).count() == 0


def test_late_samples_take_their_place(spark, tmp_path):
    """30 arrives after 60, within the watermark's delay: the states are those of the whole series."""
    import datetime

    from tabwatch.spec import AlertRule
    from tabwatch.streaming import streams as ST

    rule = AlertRule("R", "m", ">", 1.0, 30, "warning")
    start = datetime.datetime(2024, 1, 1)
    schema = "metric string, series string, t timestamp_ntz, value double"
    rows = lambda at: [("m", "s", start + datetime.timedelta(seconds=k), 2.0) for k in at]
    src, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for batch in ([0, 15, 45, 60], [30, 75], [100_000]):
        spark.createDataFrame(rows(batch), schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        ST.run_available_now(ST.alert_state_stream(stream, [rule]), out, ckpt)
    got = {int((r.t - start).total_seconds()): r.state for r in spark.read.parquet(out).collect()}
    assert got == {0: "pending", 15: "pending", 30: "firing", 45: "firing", 60: "firing", 75: "firing"}
    batch = J.alert_for_duration(spark.createDataFrame(rows([0, 15, 30, 45, 60, 75]), schema), [rule])
    assert {int((r.t - start).total_seconds()): r.state for r in batch.collect()} == got


def test_islands_are_stitched_over_chunks_of_time(spark, monkeypatch):
    """Chunks of a few samples give the states of one long window, and no window holds a whole series."""
    import datetime
    import random

    from tabwatch.spec import AlertRule

    monkeypatch.setattr(J, "CHUNK_SAMPLES", 7, raising=False)
    rule = AlertRule("R", "m", ">", 1.0, 60, "warning")
    start, rng = datetime.datetime(2024, 1, 1), random.Random(5)
    rows, want = [], {}
    for series, low in (("long", 0.02), ("mixed", 0.4), (None, 0.2)):
        at, island, last, breached = 0, None, None, False
        for _ in range(120):
            at += rng.choice((5, 15, 15, 15, 40)) if low > 0.1 else 15
            value = rng.choice((0.5, None)) if rng.random() < low else 2.0
            rows.append(("m", series, start + datetime.timedelta(seconds=at), value))
            if value == 2.0:
                island = at if not breached or at - last > 15 else island
                want[series, at] = (island, "firing" if at - island >= 60 else "pending")
            last, breached = at, value == 2.0
    rng.shuffle(rows)
    states = J.alert_for_duration(spark.createDataFrame(rows, "metric string, series string, t timestamp_ntz, value double"), [rule])
    seconds = lambda t: int((t - start).total_seconds())
    assert {(r.series, seconds(r.t)): (seconds(r.island_start), r.state) for r in states.collect()} == want
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert windows and all("_chunk" in x for x in windows)
    empty = spark.createDataFrame([], "metric string, series string, t timestamp_ntz, value double")
    assert J.alert_for_duration(empty, [rule]).count() == 0


def test_prediction_events_of_a_killed_stream_come_once(spark, tmp_path, monkeypatch):
    """The writer dies after its second batch is written and before it is committed; the restart repeats it."""
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").cast("string").alias("prediction_id"), F.lit("m").alias("model_name"),
                                                F.lit("1").alias("predicted_class"), F.lit("{}").alias("features"),
                                                F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    src = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    plain, seen = A.to_prediction_events, []

    class Dies:
        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            return getattr(self.df, name)

        @property
        def write(self):
            return self

        def mode(self, m):
            return self

        def parquet(self, path):
            self.df.write.mode("overwrite").parquet(path)
            seen.append(path)
            if len(seen) == 2:
                raise KeyError("killed")

    monkeypatch.setattr(A, "to_prediction_events", lambda df: Dies(plain(df)))
    with pytest.raises(Exception):
        ST.write_prediction_events(src(), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert len(seen) == 2
    ST.write_prediction_events(src(), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = [r.prediction_id for r in spark.read.schema(A.PREDICTION_EVENTS_SCHEMA).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=int) == [str(i) for i in range(40)] and seen[2] == seen[1]


def test_stream_events_are_one_a_row(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    got = q_score_stream_events(spark, SF_SMALL)
    assert got.columns == [c for c in A.PREDICTION_EVENTS_SCHEMA.names if c != "latency_ms"] and len(got.columns) == 13
    assert got.count() == got.select("prediction_id").distinct().count() == li.count()
    assert got.where("predicted_class is null or features is null or created_at is null").count() == 0



def test_feedback_beyond_the_state_is_dealt_over_streams(spark, monkeypatch, tmp_path):
    """With room for 40 rows of state, 150 rows go through several streams and give what one gives
    (before: one stream, whose state held every row)."""
    import datetime

    from tabwatch.plans import q_streams

    day = datetime.datetime(1995, 1, 1)
    orders = [(k if k != 7 else None, day + datetime.timedelta(days=k), k) for k in range(50)] + [(3, day, 1), (None, day, 2)]
    items = [(k % 60 if k % 17 else None, k % 5, day + datetime.timedelta(days=k % 90), "A", "F", k, k) for k in range(100)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_returnflag string, l_linestatus string, "
                          "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    one = sorted(map(str, q_streams.q_attach_feedback_stream(spark, str(tmp_path)).collect()))
    streams, attach = [], q_streams.ST.attach_feedback_stream
    monkeypatch.setattr(q_streams.ST, "attach_feedback_stream", lambda *a, **k: streams.append(a) or attach(*a, **k))
    monkeypatch.setattr(q_streams, "STATE_ROWS", 40, raising=False)
    assert sorted(map(str, q_streams.q_attach_feedback_stream(spark, str(tmp_path)).collect())) == one
    assert len(one) == 52 and len(streams) == 4
