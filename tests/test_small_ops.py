"""Hand-checked tiny frames for a few operators the oracle binds only indirectly."""

from pyspark.sql import functions as F

from tabwatch.operators import clean as B
from tabwatch.operators import metrics as J
from tabwatch.operators.score import python_deterministic_id


def test_prediction_counts_fallback(spark):
    df = spark.createDataFrame([("m", "1", None), ("m", None, "2"), ("m", None, None)],
                               "model_name string, prediction string, predicted_class string")
    got = {r.predicted_class: r.predictions for r in J.prediction_counts(df).collect()}
    assert got == {"1": 1, "2": 1, "unknown": 1}


def test_validate_feedback_rows(spark):
    ok = python_deterministic_id("x", 1)
    df = spark.createDataFrame([(ok, 1, "fine"), ("not-a-uuid", -1, "x" * 501), (ok, None, None)],
                               "prediction_id string, actual_class int, comment string")
    got = [r.errors for r in B.validate_feedback_rows(df).collect()]
    assert got[0] == []
    assert got[1] == ["prediction_id: invalid uuid", "actual_class: must be >= 0", "comment: at most 500 characters"]
    assert got[2] == ["actual_class: field required"]


def test_histogram_quantile_inf_bucket(spark):
    # all observations above the highest finite bound -> the highest finite bound
    bounds = (0.5, 1.0)
    df = spark.createDataFrame([(0, 0, 10)], "b0 long, b1 long, binf long")
    got = J.with_histogram_quantile(df, 0.95, ["b0", "b1", "binf"], bounds, "q").collect()[0].q
    assert got == 1.0
    df = spark.createDataFrame([(10, 10, 10)], "b0 long, b1 long, binf long")
    got = J.with_histogram_quantile(df, 0.5, ["b0", "b1", "binf"], bounds, "q").collect()[0].q
    assert got == 0.25      # linear inside the first bucket, which starts at 0
