"""Bracketed quantiles and missing values: NaN counts as NULL from fit to apply."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwatch.operators import prepare as P
from tabwatch.operators import profile as D
from tabwatch.operators import quantiles as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def check(spark, x, **columns):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double")
    got = Q.column_quantiles(df, {"x": F.col("x")}, PROBS)["x"]
    kept = [v for v in x if v is not None and not np.isnan(v)]
    assert got == pytest.approx([float(np.quantile(kept, p)) for p in PROBS]) if kept else got == [None] * len(PROBS)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.just(float("nan")), st.integers(-9, 9)), max_size=40))
def test_small_columns(spark, values):
    check(spark, values)


@pytest.mark.parametrize("most", [Q.MOST, 5, 60])
def test_brackets_are_narrowed_until_they_are_small(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "MOST", most)
    monkeypatch.setattr(Q, "SKETCH", 16)
    rng = np.random.default_rng(0)
    check(spark, rng.normal(size=4000).tolist())
    check(spark, np.concatenate([np.full(3000, 2.0), rng.normal(size=900), np.full(100, -7.0)]).tolist())


def test_several_columns_and_expressions(spark):
    df = spark.range(1001).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit(None).cast("double").alias("c"))
    got = Q.column_quantiles(df, {"a": F.col("a"), "half": F.col("a") / 2, "b": F.col("b"), "c": F.col("c")}, [0.5, 0.25])
    assert got == {"a": [500.0, 250.0], "half": [250.0, 125.0], "b": [3.0, 1.0], "c": [None, None]}


NAN = float("nan")


@pytest.fixture(scope="module")
def dirty(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    rows = [(float(v), {0: None, 1: NAN}.get(k % 6, float(v) * 2), float(k % 5)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "x double, y double, z double")


def numbers(df, c):
    return np.array([r[0] for r in df.select(c).collect() if r[0] is not None and not np.isnan(r[0])])


def test_profiles_leave_nan_out(spark, dirty):
    y = numbers(dirty, "y")
    d = {r.feature: r for r in D.describe_numeric(dirty, ["x", "y"]).collect()}["y"]
    assert d["count"] == len(y) and d["mean"] == pytest.approx(y.mean()) and d["std"] == pytest.approx(y.std(ddof=1))
    assert (d["min"], d["q50"], d["max"]) == pytest.approx((y.min(), np.median(y), y.max()))
    missing = {r.column: r.null_count for r in D.null_counts(dirty).collect()}
    assert missing == {"x": 0, "y": 200 - len(y), "z": 0}
    assert {r.column: r.non_null for r in D.profile_schema(dirty).collect()}["y"] == len(y)
    assert sum(r["count"] for r in D.histogram(dirty, ["y"], bins=7).collect()) == len(y)
    assert sum(r["count"] for r in D.pair_density(dirty, ["y"], "z").collect()) == len(y)
    both = [(r.x, r.y) for r in dirty.collect() if r.y is not None and not np.isnan(r.y)]
    corr = {(r.feature_x, r.feature_y): r.corr for r in D.correlation_matrix(dirty, ["x", "y"]).collect()}
    assert corr["x", "y"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    assert D.target_correlation(dirty, ["y"], "x").collect()[0].corr == pytest.approx(corr["x", "y"])
    q1, q3 = np.quantile(y, [0.25, 0.75])
    out = D.outlier_counts(dirty, ["y"]).collect()[0]
    assert out.outliers == int(((y < q1 - 1.5 * (q3 - q1)) | (y > q3 + 1.5 * (q3 - q1))).sum())
    assert D.boxplot_stats(dirty, ["y"]).collect()[0].fliers == out.outliers


@pytest.mark.parametrize("scaling", ["standard", "minmax", "none"])
def test_preparation_imputes_nan(spark, dirty, scaling):
    params = {r.feature: r for r in P.fit_preparation(dirty, ["x", "y"], scaling=scaling).collect()}
    y, p = numbers(dirty, "y"), params["y"]
    filled = np.concatenate([y, np.full(200 - len(y), np.median(y))])
    q1, q3 = np.quantile(filled, [0.25, 0.75])
    assert (p.median, p.q1, p.q3) == pytest.approx((np.median(y), q1, q3))
    cut = np.clip(filled, p.lower, p.upper)
    want = {"standard": (cut.mean(), cut.std()), "minmax": (cut.min(), cut.max() - cut.min()), "none": (0, 1)}[scaling]
    assert (p.center, p.scale) == pytest.approx(want)
    got = numbers(P.apply_preparation(dirty, {k: v.asDict() for k, v in params.items()}, ["x", "y"]), "y")
    assert len(got) == 200 and sorted(got) == pytest.approx(sorted((cut - p.center) / p.scale))


def test_single_steps_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (3.0,)], "x double")
    assert [r.x for r in P.impute_median(df, P.fit_median(df, ["x"])).collect()] == [1.0, 2.0, 2.0, 3.0]
    assert [r.x for r in P.clip_iqr(df, {"x": {"lower": 2.0, "upper": 5.0}}).collect()] == [2.0, None, None, 3.0]
    assert P.fit_scaler(df, ["x"], "minmax").collect()[0].scale == 2.0


def test_a_feature_without_values_is_named(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, NAN)], "a double, b double")
    with pytest.raises(ValueError, match="b"):
        P.fit_preparation(df, ["a", "b"])


def test_few_values_are_settled_by_counts_alone(spark, monkeypatch):
    """Ranks among rows that equal an end of their bracket take no scan of the rows inside; others do, with the same values."""
    collected, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: collected.append(df.columns) or collect(df))
    monkeypatch.setattr(Q, "MOST", 50)
    df = spark.range(4000).select((F.col("id") % 5).cast("double").alias("few"), (-F.col("id") % 2).cast("double").alias("two"),
                                  F.when(F.col("id") % 3 > 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"),
                                  (F.col("id") * 7919 % 4001).cast("double").alias("many"))
    rows, probs = df.toPandas(), [0.0, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0]
    collected.clear()
    got = Q.column_quantiles(df, {c: F.col(c) for c in ("few", "two", "zero")}, probs)
    assert collected and not any("upto" in columns for columns in collected) and all(str(v) == "0.0" for v in got["zero"])
    got.update(Q.column_quantiles(df, {"many": F.col("many")}, probs))
    assert any("upto" in columns for columns in collected)
    for c in df.columns:
        assert got[c] == pytest.approx(list(np.quantile(rows[c], probs))), c
