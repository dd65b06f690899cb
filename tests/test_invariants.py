"""Property-style invariants on random inputs (small, so each example is one quick Spark job)."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwatch.functions.reshape import to_long
from tabwatch.operators import evaluate as G
from tabwatch.operators.prefix import exact_quantiles

_SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@_SETTINGS
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60),
       st.sampled_from([1, 3]))
def test_quantiles_equal_numpy(spark, values, buckets):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r.p: r.q for r in exact_quantiles(to_long(df, ["x"]), ["feature"], "value", [0.1, 0.5, 0.9], buckets=buckets).collect()}
    for p in (0.1, 0.5, 0.9):
        assert got[p] == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)), abs=1e-9)


@_SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=2, max_size=60))
def test_auc_in_unit_interval_and_matches_pairs(spark, rows):
    df = spark.createDataFrame([(y, s / 5.0) for y, s in rows], "y int, score double").withColumn("class", F.lit(0))
    r = G.roc_auc_per_class(df).collect()[0]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        assert r.auc is None
        return
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert 0.0 <= r.auc <= 1.0 and r.auc == pytest.approx(want)


def test_split_by_cuts_and_by_ranks_agree(spark):
    """The same rows in the same columns, text and number columns in any order, and with keys that repeat or are null."""
    from tabwatch.operators.checks import check_reproducible
    from tabwatch.operators.prepare import stratified_split

    rows = [(k if k % 11 else None, f"{k % 3}-CLASS", k % 2) for k in range(300)] + [(k % 7, "0-CLASS", 0) for k in range(90)]
    df = spark.createDataFrame(rows, "k long, c string, x int")
    a, b = stratified_split(df, "c", ["k"]), stratified_split(df, "c", ["k"], buckets=3)
    assert a.columns == b.columns == ["k", "c", "x", "split"]
    assert [tuple(r) for r in check_reproducible(a, b).collect()] == [("reproducible", True, "0/0")]
    assert [tuple(r) for r in check_reproducible(a, b.select("split", "x", "c", "k")).collect()] == [("reproducible", True, "0/0")]
    other = b.withColumn("split", F.when(F.col("k") == 5, "none").otherwise(F.col("split")))
    assert check_reproducible(a, other).first().passed is False
