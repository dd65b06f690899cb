"""Drift and retraining decisions on values whose statistics are worked out by hand."""

import numpy as np
import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from tabwatch.operators import monitor as M
from tabwatch.spec import DriftConfig, PerformanceConfig


def column(spark, **values):
    return spark.createDataFrame(list(zip(*[[float(v) for v in x] for x in values.values()])), ", ".join(f"{c} double" for c in values))


def test_statistic_by_hand(spark):
    """1..4 against 3..6: the curves are furthest apart from 2 to 3, where 2 of 4 and 0 of 4 are below."""
    det = M.drift_details(column(spark, x=[1, 2, 3, 4]), column(spark, x=[3, 4, 5, 6]), ["x"]).collect()[0]
    assert det.ks_statistic == 0.5 and (det.n_reference, det.n_current) == (4, 4)
    ties = M.drift_details(column(spark, x=[1, 1, 1, 2]), column(spark, x=[1, 2, 2, 2]), ["x"]).collect()[0]
    assert ties.ks_statistic == 0.5


def test_equal_and_disjoint_columns(spark):
    a = column(spark, same=range(300), apart=range(300))
    b = column(spark, same=range(300), apart=range(1000, 1300))
    report = M.drift_report(a, b, ["same", "apart"]).collect()[0]
    assert report.features["same"]["ks_statistic"] == 0 and report.features["apart"]["ks_statistic"] == 1
    assert (report.features_tested, report.features_drifted, report.drift_ratio, report.drift_detected) == (2, 1, 0.5, True)


def test_lineitem_against_itself_and_a_shifted_slice(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_linenumber", "l_quantity", "l_extendedprice")
    odd, even = (li.where(F.col("l_linenumber") % 2 == k) for k in (1, 0))
    feats = ["l_quantity", "l_extendedprice"]
    assert M.drift_report(odd, even, feats).collect()[0].features_drifted == 0
    shifted = even.withColumn("l_quantity", F.col("l_quantity") + 30)
    assert {k: v["drifted"] for k, v in M.drift_report(odd, shifted, feats).collect()[0].features.items()} == {
        "l_quantity": True, "l_extendedprice": False}


def test_small_statistics_are_no_drift(spark):
    """Significant with many rows, but below the least statistic."""
    a, b = column(spark, x=range(0, 40_000)), column(spark, x=range(2_000, 42_000))
    det = M.drift_details(a, b, ["x"]).collect()[0]
    assert det.p_value < 1e-9 and det.ks_statistic == pytest.approx(0.05) and not det.drifted


def test_p_value_is_the_series(spark):
    a, b = np.arange(90.0), np.arange(70.0) * 1.3 + 5
    det = M.drift_details(column(spark, x=a), column(spark, x=b), ["x"]).collect()[0]
    grid = np.union1d(a, b)
    d = np.abs(np.searchsorted(a, grid, "right") / 90 - np.searchsorted(b, grid, "right") / 70).max()
    assert det.ks_statistic == pytest.approx(d)
    z = np.sqrt(90 * 70 / 160) * d
    assert det.p_value == pytest.approx(2 * sum((-1) ** (k - 1) * np.exp(-2 * (k * z) ** 2) for k in range(1, 101)), rel=1e-9)
    swapped = M.ks_two_sample(column(spark, x=b), column(spark, x=a), ["x"]).collect()[0]
    assert swapped.ks_statistic == pytest.approx(d)


D, P = DriftConfig(), PerformanceConfig()
CASES = [  # (current samples, drift ratio), (labelled samples, accuracy) at and beside each threshold -> reason
    ((D.minimum_samples, D.detection_ratio), (P.minimum_feedbacks, P.minimum_accuracy), "drift_ratio=0.300"),
    ((D.minimum_samples - 1, 1.0), (P.minimum_feedbacks, P.minimum_accuracy), "none"),
    ((D.minimum_samples, 0.2999), (P.minimum_feedbacks, 0.5499), "rolling_accuracy=0.550"),
    ((D.minimum_samples, 0.2999), (P.minimum_feedbacks - 1, 0.0), "none"),
    ((10_000, 0.75), (10_000, 0.25), "drift_ratio=0.750,rolling_accuracy=0.250"),
    (None, (P.minimum_feedbacks, 0.125), "rolling_accuracy=0.125"),
    ((D.minimum_samples, 0.5), None, "drift_ratio=0.500"),
    ((None, None), (None, None), "none"),
]


@pytest.mark.parametrize("drift,performance,reason", CASES)
def test_decisions_at_the_thresholds(spark, drift, performance, reason):
    d = spark.createDataFrame([drift], "current_samples long, drift_ratio double") if drift else None
    p = spark.createDataFrame([performance], "labeled_sample_size long, rolling_accuracy double") if performance else None
    r = M.retraining_decision(d, p).collect()[0]
    assert (r.reason, r.retraining_required) == (reason, reason != "none")


@pytest.mark.parametrize("n,status", [(D.minimum_samples - 1, "insufficient_samples"), (D.minimum_samples, "ok")])
def test_gate(spark, n, status):
    assert M.drift_gate(spark.createDataFrame([(n,)], "current_samples long")).collect()[0].status == status


def test_all_feedback_counts_unless_a_limit_is_given(spark):
    rows = [(str(k), "a", "a" if k % 4 else "b", k) for k in range(700)]
    events = spark.createDataFrame(rows, "prediction_id string, actual_class string, predicted_class string, feedback_at long")
    assert M.latest_feedback(events).count() == 700
    newest = M.latest_feedback(events, config=PerformanceConfig(limit=20))
    assert sorted(r.feedback_at for r in newest.collect()) == list(range(680, 700))
    r = M.rolling_performance(M.latest_feedback(events)).collect()[0]
    assert r.labeled_sample_size == 700 and r.rolling_accuracy == pytest.approx(0.75)
