"""Request metrics and alert rules over a request log.

The request log is (request_id, ts, method, path, status_code, duration_ms). Range
functions (rate over 5m evaluated every 15 s) are computed WITHOUT a global ordered window:
rows are first pre-aggregated to their 15 s step, then each step row is exploded into the
20 evaluation times whose (t - 300 s, t] range covers it, and summed per evaluation time.
That is fully parallel and bounded (20 x #steps rows per series).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.functions.columns import compare, safe_div
from tabwatch.operators.prefix import add_buckets, exact_quantiles, plan_buckets
from tabwatch.session import materialize
from tabwatch.spec import DEFAULT_ALERT_RULES, EVAL_STEP_SECONDS, LATENCY_BUCKETS, RATE_RANGE_SECONDS

#: Samples of a series that one chunk of time holds, about.
CHUNK_SAMPLES = 50_000

LE_LABELS = [str(float(b)) for b in LATENCY_BUCKETS] + ["+Inf"]


def epoch_seconds(ts) -> F.Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")) / 1_000_000.0


def to_ntz(seconds) -> F.Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def step_end(ts, step: int = EVAL_STEP_SECONDS) -> F.Column:
    """Smallest evaluation time >= ts on the step grid (epoch seconds, long)."""
    return (F.ceil(epoch_seconds(ts) / step) * step).cast("long")


def request_counts(log: DataFrame) -> DataFrame:
    """Requests by method, path, status."""
    return log.groupBy("method", "path", "status_code").agg(F.count(F.lit(1)).alias("requests"))


def error_counts(log: DataFrame) -> DataFrame:
    """5xx responses by method, path."""
    return log.where(F.col("status_code") >= 500).groupBy("method", "path").agg(F.count(F.lit(1)).alias("errors"))


def latency_histogram(log: DataFrame, by=("method", "path")) -> DataFrame:
    """Cumulative ``le`` bucket counts, sum and count of durations (seconds) per series.

    One wide aggregate pass, then the per-series row is inlined to long form.
    """
    d = F.col("duration_ms") / 1000.0
    aggs = [F.count_if(d <= b).alias(f"_b{i}") for i, b in enumerate(LATENCY_BUCKETS)]
    aggs += [F.count(F.lit(1)).alias("_b_inf"), F.sum(d).alias("duration_sum")]
    g = log.groupBy(*by).agg(*aggs)
    items = [F.struct(F.lit(lbl).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
             for i, lbl in enumerate(LE_LABELS[:-1])] + [
        F.struct(F.lit("+Inf").alias("le"), F.col("_b_inf").alias("bucket_count"))]
    return g.select(*by, "duration_sum", F.col("_b_inf").alias("duration_count"), F.inline(F.array(*items)))


def prediction_counts(preds: DataFrame, model: str = "model_name", 
                      keys=("prediction", "predicted_class", "predicted_quality", "quality")) -> DataFrame:
    """Predictions by model and class; class key falls back through ``keys`` then 'unknown'."""
    cls = F.coalesce(*[F.col(k).cast("string") for k in keys if k in preds.columns], F.lit("unknown"))
    return preds.groupBy(F.col(model).alias("model_name"), cls.alias("predicted_class")).agg(
        F.count(F.lit(1)).alias("predictions"))


def _windowed(per_step: DataFrame, measures, by=(), step: int = EVAL_STEP_SECONDS,
              range_s: int = RATE_RANGE_SECONDS) -> DataFrame:
    """Sum step-level measures over (t - range, t] for every evaluation time t they touch."""
    n = range_s // step
    ex = per_step.select(*by, *measures, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_j"), "_step")
    ex = ex.withColumn("t", F.col("_step") + F.col("_j") * step)
    return ex.groupBy(*by, "t").agg(*[F.sum(m).alias(m) for m in measures])


def _per_step(log: DataFrame, aggs, by=(), step: int = EVAL_STEP_SECONDS) -> DataFrame:
    return log.groupBy(*by, step_end("ts", step).alias("_step")).agg(*aggs)


#: Evaluation times that one row of the grid stands for.
GRID_PIECE = 4096


def _on_grid(windowed: DataFrame, measures, by=(), step: int = EVAL_STEP_SECONDS) -> DataFrame:
    """Every evaluation time of a series from its first to its last one; 0 where nothing was counted.

    Without the zeros a rule would not see that a condition has ended. The grid is made in pieces
    of ``GRID_PIECE`` times, so a long series is neither one array nor one task.
    """
    by = list(by)
    ends = windowed.groupBy(*by).agg(F.min("t").alias("_a"), F.max("t").alias("_z")).where("_a is not null")
    pieces = ends.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_z - _a) div {GRID_PIECE * step}"))))
    begin = F.col("_a") + F.col("_b") * GRID_PIECE * step
    pieces = pieces.select(*by, begin.alias("_from"), F.least("_z", begin + (GRID_PIECE - 1) * step).alias("_to"))
    pieces = pieces.repartition(*by, "_from")
    grid = pieces.select(*[F.col(c).alias("_g_" + c) for c in by], F.explode(F.sequence("_from", "_to", F.lit(step).cast("long"))).alias("_g_t"))
    same = [F.col("_g_" + c).eqNullSafe(F.col(c)) for c in [*by, "t"]]
    return grid.join(windowed, same, "left").select(
        *[F.col("_g_" + c).alias(c) for c in by], F.col("_g_t").alias("t"), *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def request_rate(log: DataFrame, by=(), step: int = EVAL_STEP_SECONDS, range_s: int = RATE_RANGE_SECONDS) -> DataFrame:
    """sum(rate(requests[5m])) at every 15 s evaluation time of a series, from its first request to
    the last window that holds one; 0 in between where no request is near."""
    ps = _per_step(log, [F.count(F.lit(1)).alias("requests")], by, step)
    w = _on_grid(materialize(_windowed(ps, ["requests"], by, step, range_s)), ["requests"], by, step)
    return w.select(*by, to_ntz(F.col("t")).alias("t"), (F.col("requests") / float(range_s)).alias("request_rate"))


def counter_increase(samples: DataFrame, series=("series",), ts: str = "t", value: str = "value") -> DataFrame:
    """Per-sample increase of a scraped cumulative counter; a drop means a reset (take cur)."""
    w = Window.partitionBy(*series).orderBy(ts)
    prev = F.lag(value).over(w)
    inc = F.when(prev.isNull(), F.lit(None)).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev)
    return samples.withColumn("increase", inc.cast("double"))


def error_ratio(log: DataFrame, threshold: float = 0.05, floor_rate: float = 0.001, step: int = EVAL_STEP_SECONDS,
                range_s: int = RATE_RANGE_SECONDS) -> DataFrame:
    """errors/s / max(requests/s, 0.001) at every evaluation time of the grid (J5); breach when > 5 %."""
    ps = _per_step(log, [F.count(F.lit(1)).alias("requests"),
                         F.count_if(F.col("status_code") >= 500).alias("errors")], (), step)
    w = _on_grid(materialize(_windowed(ps, ["requests", "errors"], (), step, range_s)), ["requests", "errors"], (), step)
    req = F.col("requests") / float(range_s)
    err = F.col("errors") / float(range_s)
    ratio = err / F.greatest(req, F.lit(floor_rate))
    return w.select(to_ntz(F.col("t")).alias("t"), req.alias("request_rate"), err.alias("error_rate"),
                    ratio.alias("error_ratio"), (ratio > threshold).alias("breach"))


def with_histogram_quantile(df: DataFrame, q: float, cum_cols, bounds, out: str) -> DataFrame:
    """Prometheus histogram_quantile over cumulative bucket count columns (last = +Inf bucket).

    The bucket holding the rank is found by summing one comparison per bucket (the bucket list
    is fixed), so the expression stays inside whole-stage codegen (no lambdas).
    """
    nb = len(bounds)
    cum = F.array(*[F.col(c) for c in cum_cols])
    b = F.array(*[F.lit(float(x)) for x in bounds])
    s1 = df.withColumn("_total", F.col(cum_cols[-1]).cast("double")).withColumn("_rank", F.lit(q) * F.col("_total"))
    idx_expr = sum((F.col(c) < F.col("_rank")).cast("int") for c in cum_cols[:nb])
    s2 = s1.withColumn("_idx", idx_expr)
    idx = F.col("_idx")
    s3 = s2.select("*", F.when(idx == 0, F.lit(0)).otherwise(F.element_at(cum, F.greatest(idx, F.lit(1)))).alias("_below"),
                   F.when(idx == 0, F.lit(0.0)).otherwise(F.element_at(b, F.greatest(idx, F.lit(1)))).alias("_lower"),
                   F.element_at(b, F.least(idx + 1, F.lit(nb))).alias("_upper"),
                   F.element_at(cum, idx + 1).alias("_here"))
    interp = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * safe_div(
        F.col("_rank") - F.col("_below"), F.col("_here") - F.col("_below"))
    val = (F.when(F.col("_total").isNull() | (F.col("_total") == 0), F.lit(None).cast("double"))
           .when(idx == nb, F.lit(float(bounds[-1]))).otherwise(interp))
    return s3.withColumn(out, val).drop("_total", "_rank", "_idx", "_below", "_lower", "_upper", "_here")


def latency_p95_buckets(log: DataFrame, q: float = 0.95, threshold: float = 2.0, step: int = EVAL_STEP_SECONDS,
                        range_s: int = RATE_RANGE_SECONDS) -> DataFrame:
    """histogram_quantile(0.95, sum by (le)(rate(bucket[5m]))) per evaluation time."""
    d = F.col("duration_ms") / 1000.0
    names = [f"_b{i}" for i in range(len(LATENCY_BUCKETS))] + ["_b_inf"]
    aggs = [F.count_if(d <= b).alias(names[i]) for i, b in enumerate(LATENCY_BUCKETS)]
    aggs.append(F.count(F.lit(1)).alias("_b_inf"))
    w = _windowed(_per_step(log, aggs, (), step), names, (), step, range_s)
    p = with_histogram_quantile(w, q, names, LATENCY_BUCKETS, "latency_p95_seconds")
    return p.select(to_ntz(F.col("t")).alias("t"), "latency_p95_seconds",
                    (F.col("latency_p95_seconds") > threshold).alias("breach"))


def latency_p95_exact(log: DataFrame, q: float = 0.95, window_s: int = RATE_RANGE_SECONDS, **kw) -> DataFrame:
    """Exact p95 of raw durations per tumbling window (distributed exact quantile)."""
    w = log.select((F.floor(epoch_seconds("ts") / window_s) * window_s).cast("long").alias("_w"),
                   (F.col("duration_ms") / 1000.0).alias("d"))
    qs = exact_quantiles(w, ["_w"], "d", [q], **kw)
    return qs.select(to_ntz(F.col("_w")).alias("window_start"), F.col("q").alias("latency_p95_seconds"))


def gauge_max(samples: DataFrame, series=("series",), ts: str = "t", value: str = "value", asof=None,
              tie=()) -> DataFrame:
    """Max over series of each series' latest sample at or before ``asof``."""
    s = samples if asof is None else samples.where(F.col(ts) <= F.lit(asof).cast(samples.schema[ts].dataType))
    latest = s.groupBy(*series).agg(F.max_by(F.col(value), F.struct(F.col(ts), *[F.col(t) for t in tie])).alias("_v"))
    return latest.agg(F.max("_v").alias("gauge_max"), F.count(F.lit(1)).alias("series"))


def rules_frame(spark, rules=DEFAULT_ALERT_RULES) -> DataFrame:
    """The alert rules as a literal table (size = number of rules)."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.metric).alias("metric"), F.lit(r.op).alias("op"),
                 F.lit(float(r.threshold)).alias("threshold"), F.lit(int(r.for_seconds)).alias("for_seconds"),
                 F.lit(r.severity).alias("severity")) for r in rules])))


def _condition(value, rules=DEFAULT_ALERT_RULES) -> F.Column:
    """Rule condition as a CASE over the rule name (rules are a fixed literal list)."""
    out = None
    for r in rules:
        cond = F.col("rule") == r.name
        res = compare(r.op, value, F.lit(float(r.threshold)))
        out = F.when(cond, res) if out is None else out.when(cond, res)
    return out


def threshold_alerts(samples: DataFrame, rules=DEFAULT_ALERT_RULES) -> DataFrame:
    """Latest sample per (metric, series) checked against every rule on that metric.

    samples: (metric, series, t, value). The rules table is a broadcast literal of #rules rows.
    """
    spark = samples.sparkSession
    latest = samples.groupBy("metric", "series").agg(F.max_by("value", F.struct("t", "value")).alias("value"), F.max("t").alias("t"))
    j = latest.join(F.broadcast(rules_frame(spark, rules)), "metric")
    return j.select("rule", "metric", "series", "t", "value", "severity",
                    F.coalesce(_condition(F.col("value"), rules), F.lit(False)).alias("firing"))


def alert_for_duration(samples: DataFrame, rules=DEFAULT_ALERT_RULES, step: int = EVAL_STEP_SECONDS) -> DataFrame:
    """Pending / firing states with the ``for`` hold time (gaps-and-islands).

    A breach island is a run of breaching samples at consecutive evaluation steps; a
    non-breaching or missing step ends it. Firing once t - island_start >= for.
    Returns only breaching samples: (rule, series, t, value, island_start, state, severity).

    Samples are cut into chunks of time of about ``CHUNK_SAMPLES`` a series (quantiles of the times;
    equal times stay together), windows run inside a chunk, and what crosses a border, the last
    sample and the last island's start of the chunks before, comes by a join on one row a chunk.
    """
    spark = samples.sparkSession
    key = ["rule", "series"]
    j = samples.join(F.broadcast(rules_frame(spark, rules)), "metric")
    j = j.withColumn("_breach", F.coalesce(_condition(F.col("value"), rules), F.lit(False)))
    j = materialize(j.withColumn("_s", epoch_seconds("t")))
    plan, edges = plan_buckets(j, key, "_s", CHUNK_SAMPLES)
    order, here = ["_s", "t", "value"], F.struct("_s", "_breach")
    parts = key if plan is None else [*key, "_chunk"]
    j = j if plan is None else add_buckets(j, key, "_s", plan, edges, "_chunk")
    w = Window.partitionBy(*parts).orderBy(*order)
    over_chunks = Window.partitionBy(*key).orderBy("_chunk")  # one row a chunk

    def bordered(rows: DataFrame, left, border) -> DataFrame:
        """Rows with ``border`` over what the chunks of their series ``left``; null where no series has two chunks."""
        if plan is None:
            return rows.withColumn("_border", F.lit(None))
        side = rows.groupBy(*parts).agg(left.alias("_left")).withColumn("_border", border)
        side = side.select(*[F.col(c).alias("_b_" + c) for c in parts], "_border")
        return rows.join(side, [F.col(c).eqNullSafe(F.col("_b_" + c)) for c in parts]).drop(*["_b_" + c for c in parts])

    j = bordered(j, F.max_by(here, F.struct(*order)), F.lag("_left").over(over_chunks))
    j = j.withColumn("_prev", F.coalesce(F.lag(here).over(w), F.col("_border"))).drop("_border")
    apart = F.coalesce(F.col("_s") - F.col("_prev._s") > step, F.lit(True))
    starts = F.col("_breach") & (F.col("_prev").isNull() | ~F.col("_prev._breach") | apart)
    j = j.withColumn("_start", F.when(starts, F.struct("_s", "t"))).drop("_prev")
    b = bordered(j, F.max("_start"), F.last("_left", ignorenulls=True).over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)))
    island = F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    b = b.withColumn("_island", F.coalesce(island, F.col("_border"))).where("_breach")
    b = b.withColumn("_first", F.col("_island._s")).withColumn("island_start", F.col("_island.t"))
    state = F.when(F.col("_s") - F.col("_first") >= F.col("for_seconds"), F.lit("firing")).otherwise(F.lit("pending"))
    return b.select("rule", "series", "t", "value", "island_start", state.alias("state"), "severity")


def probe_targets(probes: DataFrame, target: str = "target", ts: str = "ts", success: str = "success",
                  window: str = "1 day") -> DataFrame:
    """Uptime share per target per window from probe samples."""
    return probes.groupBy(F.col(target).alias("target"), F.window(F.col(ts), window).start.alias("window_start")).agg(
        F.avg(F.col(success).cast("double")).alias("uptime"), F.count(F.lit(1)).alias("probes"))
