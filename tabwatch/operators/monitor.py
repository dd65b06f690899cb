"""Drift, rolling performance and retraining decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.functions.columns import safe_div
from tabwatch.functions.ks import ks_pvalue
from tabwatch.functions.reshape import to_long
from tabwatch.operators.evaluate import confusion_counts, per_class_stats
from tabwatch.operators.prefix import running_totals
from tabwatch.session import materialize
from tabwatch.spec import DriftConfig, PerformanceConfig


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def ks_two_sample(ref: DataFrame, cur: DataFrame, features, **kw) -> DataFrame:
    """Per feature (feature, ks_statistic, n_reference, n_current); NULL / NaN dropped per column.

    Long form (feature, value, side) -> side counts per distinct value -> bucketed prefix
    sums -> max |F_ref - F_cur|. No per-feature collect; ties stay whole.
    """
    feats = list(features)
    kw.setdefault("max_groups", len(feats))
    return ks_two_sample_long(to_long(ref, feats), to_long(cur, feats), **kw)


def ks_two_sample_long(ref_long: DataFrame, cur_long: DataFrame, **kw) -> DataFrame:
    """I1 on long frames (feature, value): e.g. current features expanded from JSON."""
    lr = ref_long.select("feature", F.col("value").cast("double").alias("value"), F.lit(0).alias("_side"))
    lc = cur_long.select("feature", F.col("value").cast("double").alias("value"), F.lit(1).alias("_side"))
    u = lr.unionByName(lc).where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = materialize(u.groupBy("feature", "value").agg(
        F.count_if(F.col("_side") == 0).alias("c_ref"), F.count_if(F.col("_side") == 1).alias("c_cur")))
    totals = counts.groupBy("feature").agg(F.sum("c_ref").alias("n_reference"),
                                           F.sum("c_cur").alias("n_current"))
    rt = running_totals(counts, ["feature"], "value", ["c_ref", "c_cur"], **kw).join(totals, "feature")
    gap = F.abs(safe_div(F.col("cum_c_ref"), F.col("n_reference")) - safe_div(F.col("cum_c_cur"),
                                                                             F.col("n_current")))
    return rt.groupBy("feature").agg(F.max(gap).alias("ks_statistic"),
                                     F.first("n_reference").alias("n_reference"),
                                     F.first("n_current").alias("n_current"))


def drift_flags(ks: DataFrame, n_features: int, config: DriftConfig = DriftConfig()) -> DataFrame:
    """I2 + I3: p-value, Bonferroni level alpha/k, drifted flag, and p_uncertain near the level."""
    level = config.alpha / n_features
    p = ks_pvalue("ks_statistic", "n_reference", "n_current")
    out = ks.withColumn("p_value", p)
    drifted = (F.col("p_value") < level) & (F.col("ks_statistic") >= config.minimum_statistic)
    uncertain = F.abs(F.col("p_value") - level) <= config.uncertain_band * level
    return out.withColumn("drifted", F.coalesce(drifted, F.lit(False))).withColumn("p_uncertain", uncertain)


def drift_details(ref: DataFrame, cur: DataFrame, features, config: DriftConfig = DriftConfig(),
                  **kw) -> DataFrame:
    feats = list(features)
    return drift_flags(ks_two_sample(ref, cur, feats, **kw), len(feats), config)


def drift_report(ref: DataFrame, cur: DataFrame, features, config: DriftConfig = DriftConfig(),
                 details: DataFrame | None = None, with_details: bool = True, **kw) -> DataFrame:
    """I4: one row: reference_samples, current_samples, features_tested, features_drifted,
    drift_ratio, drift_detected (+ ``features`` map feature -> {ks_statistic, p_value, drifted})."""
    feats = list(features)
    det = details if details is not None else drift_details(ref, cur, feats, config, **kw)
    k = len(feats)
    agg = [F.count_if("drifted").cast("long").alias("features_drifted")]
    if with_details:
        agg.append(F.map_from_entries(F.collect_list(F.struct(
            F.col("feature"), F.struct("ks_statistic", "p_value", "drifted")))).alias("features"))
    summary = det.agg(*agg)
    sizes = _one_row_join(ref.agg(F.count(F.lit(1)).alias("reference_samples")),
                          cur.agg(F.count(F.lit(1)).alias("current_samples")))
    out = _one_row_join(sizes, summary)
    ratio = F.col("features_drifted") / F.lit(float(k))
    out = out.withColumn("features_tested", F.lit(k).cast("long")).withColumn("drift_ratio", ratio)
    out = out.withColumn("drift_detected", F.col("drift_ratio") >= config.detection_ratio)
    cols = ["reference_samples", "current_samples", "features_tested", "features_drifted", "drift_ratio",
            "drift_detected"] + (["features"] if with_details else [])
    return out.select(*cols)


def drift_gate(report: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """status = insufficient_samples below the minimum current sample (no run row saved)."""
    return report.withColumn("status", F.when(F.col("current_samples") < config.minimum_samples,
                                              F.lit("insufficient_samples")).otherwise(F.lit("ok")))


def latest_feedback(events: DataFrame, actual: str = "actual_class", predicted: str = "predicted_class",
                    at: str = "feedback_at", id_col: str = "prediction_id",
                    config: PerformanceConfig = PerformanceConfig()) -> DataFrame:
    """Labelled events: all, or the newest ``config.limit`` by feedback time (TakeOrderedAndProject)."""
    labelled = events.where(F.col(actual).isNotNull())
    if config.limit is not None:
        labelled = labelled.orderBy(F.desc(at), F.asc(id_col)).limit(config.limit)
    return labelled.select(id_col, actual, predicted, at)


def rolling_performance(labelled: DataFrame, actual: str = "actual_class", predicted: str = "predicted_class",
                        config: PerformanceConfig = PerformanceConfig()) -> DataFrame:
    """labeled_sample_size, enough_feedback, rolling_accuracy, rolling_f1_weighted, degraded."""
    stats = per_class_stats(confusion_counts(labelled, actual, predicted))
    n = F.sum("support")
    s = stats.agg(n.cast("long").alias("labeled_sample_size"),
                  safe_div(F.sum("tp"), n).alias("_acc"),
                  F.coalesce(safe_div(F.sum(F.col("f1") * F.col("support")), n), F.lit(0.0)).alias("_f1"))
    size = labelled.agg(F.count(F.lit(1)).alias("labeled_sample_size"))
    s = _one_row_join(size, s.drop("labeled_sample_size"))
    enough = F.col("labeled_sample_size") >= config.minimum_feedbacks
    return s.select("labeled_sample_size", enough.alias("enough_feedback"),
                    F.when(enough, F.col("_acc")).alias("rolling_accuracy"),
                    F.when(enough, F.col("_f1")).alias("rolling_f1_weighted"),
                    (enough & (F.col("_acc") < config.minimum_accuracy)).alias("performance_degraded"))


def retraining_decision(drift: DataFrame | None, performance: DataFrame | None,
                        drift_cfg: DriftConfig = DriftConfig(),
                        perf_cfg: PerformanceConfig = PerformanceConfig()) -> DataFrame:
    """I8: (retraining_required, reason); missing reports take neutral defaults."""
    spark = (drift if drift is not None else performance).sparkSession
    d = drift.select("current_samples", "drift_ratio") if drift is not None else spark.range(1).select(
        F.lit(None).cast("long").alias("current_samples"), F.lit(None).cast("double").alias("drift_ratio"))
    p = performance.select("labeled_sample_size", "rolling_accuracy") if performance is not None else \
        spark.range(1).select(F.lit(None).cast("long").alias("labeled_sample_size"),
                              F.lit(None).cast("double").alias("rolling_accuracy"))
    j = _one_row_join(d, p)
    return j.select(*decision_columns(F.col("current_samples"), F.col("drift_ratio"),
                                      F.col("labeled_sample_size"), F.col("rolling_accuracy"),
                                      drift_cfg, perf_cfg))


def decision_columns(current, ratio, labeled, acc, drift_cfg: DriftConfig = DriftConfig(),
                     perf_cfg: PerformanceConfig = PerformanceConfig()):
    current = F.coalesce(current, F.lit(0))
    ratio = F.coalesce(ratio, F.lit(0.0))
    labeled = F.coalesce(labeled, F.lit(0))
    acc = F.coalesce(acc, F.lit(1.0))
    r_drift = F.when((current >= drift_cfg.minimum_samples) & (ratio >= drift_cfg.detection_ratio),
                     F.concat(F.lit("drift_ratio="), F.format_string("%.3f", ratio)))
    r_acc = F.when((labeled >= perf_cfg.minimum_feedbacks) & (acc < perf_cfg.minimum_accuracy),
                   F.concat(F.lit("rolling_accuracy="), F.format_string("%.3f", acc)))
    reason = F.concat_ws(",", r_drift, r_acc)
    return [(reason != "").alias("retraining_required"),
            F.when(reason == "", F.lit("none")).otherwise(reason).alias("reason")]


def latest_non_null(runs: DataFrame, cols=("drift_ratio", "rolling_accuracy"), ts: str = "created_at",
                    tie: str = "monitoring_run_id", companions: dict | None = None) -> DataFrame:
    """Newest non-NULL value of each column (a NULL at the newest row does not hide older data).

    companions = {"drift_detected": "drift_ratio"} takes a column from the row that gave another.
    """
    companions = companions or {}
    aggs = []
    for c in cols:
        order = F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(tie)))
        aggs.append(F.max_by(F.col(c), order).alias(c))
    for c, src in companions.items():
        order = F.when(F.col(src).isNotNull(), F.struct(F.col(ts), F.col(tie)))
        aggs.append(F.max_by(F.col(c), order).alias(c))
    return runs.agg(*aggs)
