"""Rows that are not as they should be: overflowing, mixed, malformed or ambiguous."""

import datetime

import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler

from tabwatch.operators import clean as B
from tabwatch.operators import metrics as J
from tabwatch.operators import score as S
from tabwatch.sources import files as A
from tabwatch.spec import TARGET_CANDIDATES


def test_large_targets_become_null(spark):
    df = spark.createDataFrame([("3e10",), ("1e300",), ("7",), ("-2147483648",)], "q string")
    assert [r.q for r in B.coerce_numeric(df, [], target="q").collect()] == [None, None, 7, -2147483648]


def test_json_keys_without_numbers_are_left_out(spark):
    df = spark.createDataFrame([(1, '{"k":1.5,"name":"abc","n":null,"b":true,"o":{"x":1}}'), (2, "not json"), (3, "{}"), (4, None)], "id int, j string")
    got = sorted((r.id, r.feature, r.value) for r in B.expand_json_features(df, "j", ids=["id"]).collect())
    assert got == [(1, "k", 1.5), (1, "n", None)]


def test_targets_are_found_in_order_and_are_no_features(spark):
    df = spark.createDataFrame([(1.0, 2, 3, 4.0)], "a double, quality int, label int, quality_label double")
    assert B.find_target_column(df, TARGET_CANDIDATES) == "quality_label"
    assert B.find_target_column(df.drop("quality_label"), TARGET_CANDIDATES) == "label"
    assert B.common_numeric_features(df, df) == ["a"]
    with pytest.raises(ValueError):
        B.common_numeric_features(df.drop("a"), df)


def test_log_lines_as_the_logger_writes_them(spark, tmp_path):
    (tmp_path / "app.log").write_text("\n".join([
        '{"asctime": "2024-01-31 12:00:00,250", "levelname": "INFO", "name": "app", "message": "request_completed", '
        '"request_id": "r1", "method": "GET", "path": "/x", "status_code": 200, "duration_ms": 12.5}',
        '{"asctime": "yesterday", "request_id": "r2"}', "no json at all", '{"asctime": null, "request_id": "r3"}']))
    rows = {r.request_id: r for r in A.ingest_json_log(spark, str(tmp_path)).collect()}
    assert rows["r1"].ts == datetime.datetime(2024, 1, 31, 12, 0, 0, 250_000) and rows["r1"].duration_ms == 12.5
    assert rows["r2"].ts is None and rows["r3"].ts is None


def test_prediction_class_keys(spark):
    df = spark.createDataFrame([("m", None, "high", None), ("m", None, None, "5"), ("m", None, None, None)],
                               "model_name string, prediction string, predicted_quality string, quality string")
    assert {r.predicted_class: r.predictions for r in J.prediction_counts(df).collect()} == {"high": 1, "5": 1, "unknown": 1}


def test_alerts_take_the_larger_of_two_samples_at_one_time(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("error_ratio", "api", t, v) for v in (0.01, 0.5, 0.02)], "metric string, series string, t timestamp_ntz, value double")
    assert J.threshold_alerts(df).where("rule = 'ApiHighErrorRate'").collect()[0].value == 0.5


def test_boosted_models_can_score(spark):
    df = spark.createDataFrame([(float(k % 3), float(k % 3), float(k)) for k in range(30)], "label double, a double, b double")
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = OneVsRest(classifier=GBTClassifier(maxIter=2, maxDepth=2)).fit(vec)
    rows = S.score_batch(df, model, None, ["a", "b"], keep=["label"]).collect()
    assert all(r.predicted_class == int(r.label) and sum(r.probabilities.values()) == pytest.approx(1) for r in rows)
