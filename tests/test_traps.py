"""Hand-computed tiny frames for the semantic traps."""

import math

import pytest
from pyspark.sql import functions as F

from tabwatch.operators import checks as K
from tabwatch.operators import clean as B
from tabwatch.operators import evaluate as G
from tabwatch.operators import monitor as M
from tabwatch.operators import prepare as P
from tabwatch.operators import profile as D
from tabwatch.operators import score as S
from tabwatch.operators.metrics import alert_for_duration
from tabwatch.spec import AlertRule, SplitConfig


def test_t1_coercion(spark):
    vals = ["abc", " 1.5 ", "NaN", "1d", "1e3", "inf", "", "-.5", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x string")
    got = [r.x for r in B.coerce_numeric(df, ["x"]).orderBy("i").collect()]
    assert got == [None, 1.5, None, None, 1000.0, None, None, -0.5, None]


def test_t1_fractional_target_is_null(spark):
    df = spark.createDataFrame([("5",), ("6.5",), ("7.0",)], "q string")
    got = [r.q for r in B.coerce_numeric(df, [], target="q").collect()]
    assert got == [5, None, 7]


def test_t2_null_target_dropped(spark):
    df = spark.createDataFrame([(5,), (6,), (7,), (None,)], "quality int")
    lab = B.bucket_label(df, "quality")
    kept = B.drop_invalid_targets(lab, ["quality_label", "quality_class"])
    assert kept.count() == 3
    assert sorted(r.quality_class for r in kept.collect()) == [0, 1, 2]


def test_t3_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "x double")
    got = [r.x for r in P.clip_iqr(df, {"x": {"lower": 0.0, "upper": 1.0}}).collect()]
    assert got == [0.0, 0.5, 1.0, None]


def test_t4_constant_column(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "x double, z double")
    corr = {(r.feature_x, r.feature_y): r.corr for r in D.correlation_matrix(df, ["x", "z"]).collect()}
    assert corr[("x", "z")] is None and corr[("z", "z")] is None
    assert corr[("x", "x")] == pytest.approx(1.0)
    for kind in ("standard", "minmax"):
        p = {r.feature: r.asDict() for r in P.fit_scaler(df, ["x", "z"], kind).collect()}
        scaled = P.scale(df, p).collect()
        assert [r.z for r in scaled] == [0.0, 0.0]


def test_quartiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    b = P.fit_iqr_bounds(df, ["x"]).collect()[0]
    assert (b.q1, b.q3) == (1.75, 5.25)
    assert P.fit_median(df, ["x"]).collect()[0].median == 3.0


def test_duplicates_with_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int")
    s = B.duplicate_summary(df).collect()[0]
    assert (s.rows_after, s.removed) == (2, 1)
    assert B.duplicate_rows(df).count() == 1


def test_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, score double").withColumn("class", F.lit(0))
    auc = G.roc_auc_per_class(df).collect()[0].auc
    assert auc == pytest.approx(0.5)


def test_absent_class(spark):
    df = spark.createDataFrame([(0, 0, [0.8, 0.1, 0.1]), (1, 1, [0.1, 0.8, 0.1]), (1, 0, [0.5, 0.4, 0.1])],
                               "a int, p int, s array<double>")
    m = G.classification_metrics(df, "a", "p", "s", [0, 1, 2]).collect()[0]
    assert m.roc_auc_ovr_weighted is None and m.auc_class_absent
    rep = {r.row: r for r in G.classification_report(df, "a", "p", [0, 1, 2]).collect()}
    assert rep["2"].support == 0 and rep["2"].f1 == 0.0


def test_feedback_last_wins_and_unknown(spark):
    preds = spark.createDataFrame([(1, "0"), (2, "1")], "prediction_id int, predicted_class string")
    fb = spark.createDataFrame([(1, "1", "2024-01-02"), (1, "0", "2024-01-03"), (9, "0", "2024-01-01"),
                                (2, "1", "2023-12-31")], "prediction_id int, actual_class string, feedback_at string")
    fb = fb.withColumn("feedback_at", F.col("feedback_at").cast("timestamp_ntz"))
    got = {r.prediction_id: r for r in S.attach_feedback(preds, fb).collect()}
    assert got[1].actual_class == "0" and got[1].is_correct is True
    assert got[2].actual_class == "1" and got[2].is_correct is True   # feedback before its prediction still attaches
    assert [r.prediction_id for r in S.unmatched_feedback(preds, fb).collect()] == [9]


def test_null_at_latest(spark):
    runs = spark.createDataFrame([("a", "2024-01-01", 0.6), ("b", "2024-01-02", None)],
                                 "monitoring_run_id string, created_at string, rolling_accuracy double")
    runs = runs.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = M.latest_non_null(runs, cols=("rolling_accuracy",)).collect()[0]
    assert got.rolling_accuracy == 0.6


def test_alert_island_restarts_after_gap(spark):
    rule = AlertRule("R", "m", ">", 1.0, 30, "warning")
    base = 1_700_000_000
    vals = [2, 2, 0, 2, 2, 2, 2]
    rows = [("m", "s", base + 15 * i, float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "metric string, series string, ts long, value double").withColumn(
        "t", F.timestamp_seconds("ts").cast("timestamp_ntz")).drop("ts")
    got = alert_for_duration(df, rules=(rule,)).orderBy("t").collect()
    assert [r.state for r in got] == ["pending", "pending", "pending", "pending", "firing", "firing"]
    assert got[2].island_start == got[5].island_start


@pytest.mark.parametrize("n,test,val", [(100, 15, 16), (120, 18, 18), (1500, 225, 226)])
def test_t10_split_sizes(spark, n, test, val):
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(0).alias("c"))
    s = P.stratified_split(df, "c", ["k"], SplitConfig())
    sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes["test"] == test and sizes["validation"] == val and sum(sizes.values()) == n


def test_split_disjoint_complete_aligned(spark):
    df = spark.range(1000, 1120).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("feature_a"),
                                        (F.col("id") * 2.0).alias("feature_b"), (F.col("id") % 3).alias("cls"))
    s = P.stratified_split(df, "cls", ["idx"])
    chk = {r.check: r.passed for r in K.check_split_leakage(s, df, ["idx"]).collect()}
    assert chk == {"split_disjoint": True, "split_complete": True}
    assert s.where(F.col("feature_b") != F.col("feature_a") * 2).count() == 0
    per = {(r.split, r.cls): r["count"] for r in s.groupBy("split", "cls").count().collect()}
    assert all(per[("test", c)] == 6 for c in range(3))


def test_finite_check(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (math.inf,)], "x double")
    r = K.check_finite(df, ["x"]).collect()[0]
    assert r.passed is False and r.detail == "3"


def test_register_version_and_move_alias(spark):
    from tabwatch.operators import registry as R
    versions = spark.createDataFrame([("m", 1, "r1", "2024-01-01"), ("m", 2, "r2", "2024-01-02")],
                                     "name string, version long, run_id string, created_at string").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz"))
    aliases = R.set_alias(versions.where("version = 1"))
    new = R.register_version(versions, "m", "r3", "2024-01-03 00:00:00")
    assert new.collect()[0].version == 3
    versions = versions.unionByName(new)
    aliases = aliases.unionByName(R.set_alias(new))
    got = R.resolve_model(versions, aliases).collect()[0]
    assert (got.version, got.source) == (3, "alias")
    assert R.resolve_model(versions, aliases.where("version = 0")).collect()[0].source == "latest"
