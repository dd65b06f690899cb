"""Bindings for the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.plans.catalog import register, table
from tabwatch.plans.jobs import daily_monitoring, run_preparation
from tabwatch.session import scratch_path
from tabwatch.sources import files as A

_RAW = ["Order Key", "Quantity", "Extended Price", "Discount", "Tax", "Line Number"]
_FEATS = ["Quantity", "Extended Price", "Discount", "Tax"]


@register("run_preparation")
def q_run_preparation(spark, sf):
    """Two ';' sources cut from lineitem (returned items vs the rest); target = line number with
    the default label rule (<=5 low, ==6 medium, >=7 high)."""
    li = table(spark, sf, "lineitem")
    cols = [F.col(c).cast("string").alias(n) for c, n in zip(
        ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"], _RAW)]
    base = scratch_path(spark, "prep-sources")
    A.write_delimited(li.where(F.col("l_returnflag") == "R").select(*cols), f"{base}/returned")
    A.write_delimited(li.where(F.col("l_returnflag") != "R").select(*cols), f"{base}/other")
    res = run_preparation(spark, [(f"{base}/returned", "returned"), (f"{base}/other", "other")], _RAW, _FEATS,
                          "Line Number", scratch_path(spark, "prep-out"))
    return res.prepared.groupBy("split", "quality_class").agg(
        F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in
                                           ("quantity", "extended_price", "discount", "tax")])


@register("daily_monitoring")
def q_daily_monitoring(spark, sf):
    """Reference: events before 2024-01-16 (value, k); current: prediction events of the 30 days
    before 2024-01-31 with JSON features {value, k}; feedback attached from lineitem (H3 binding)."""
    from tabwatch.plans.q_score import attached
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    ref = ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).select(
        F.col("value").cast("double").alias("value"), k.alias("k"))
    fb = attached(spark, sf).select("prediction_id", "actual_class", "feedback_at")
    events = ev.select(F.col("event_id").alias("prediction_id"), F.col("ts").alias("created_at"),
                       (F.col("user_id") % 3).cast("string").alias("predicted_class"),
                       F.to_json(F.struct(F.col("value").alias("value"), k.alias("k"))).alias("features"))
    events = events.join(fb, "prediction_id", "left")
    return daily_monitoring(ref, events, ["value", "k"], "2024-01-31 00:00:00", run_prefix="2024-01-31",
                            out_dir=scratch_path(spark, "daily-monitoring"))
