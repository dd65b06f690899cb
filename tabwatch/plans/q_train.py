"""Bindings for training, scoring and model persistence.

Training data: ``embeddings`` (64-d vectors) with a 3-class label (label <= 2 -> 0, <= 5 -> 1,
else 2) and stratified 3-fold assignment by vec_id. Scoring (H1): preparation fitted on the
lineitem rows shipped before 2000, logistic regression on the return flag class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import evaluate as G
from tabwatch.operators import prepare as P
from tabwatch.operators import registry as R
from tabwatch.operators import score as S
from tabwatch.operators import train as TR
from tabwatch.plans.catalog import LI_FEATURES, LI_KEY, TRAIN_CUT, lineitem_frame, r6, register, table
from tabwatch.session import materialize, scratch_path
from tabwatch.sources import files as A


@register("balanced_weights", """
SELECT doc_id, quality, round(count(*) OVER () / ((SELECT count(DISTINCT quality) FROM labels)
  * count(*) OVER (PARTITION BY quality)), 6) AS weight FROM labels""")
def q_balanced_weights(spark, sf):
    w = TR.balanced_weights(table(spark, sf, "labels").select("doc_id", "quality"), "quality")
    return w.select("doc_id", "quality", r6("weight").alias("weight"))


def training_frame(spark, sf):
    e = table(spark, sf, "embeddings")
    lab = F.when(F.col("label") <= 2, 0).when(F.col("label") <= 5, 1).otherwise(2).cast("double")
    df = e.select("vec_id", "embedding", lab.alias("label"))
    df = P.stratified_folds(df, "label", ["vec_id"], k=3, seed=42)
    df = TR.balanced_weights(df, "label")
    return TR.assemble(df, ["embedding"])


def _fit_predict(spark, sf, family, params):
    df = training_frame(spark, sf)
    if family == "boosted_trees":  # hundreds of trees one after another read the rows
        df = TR.dealt(materialize(df))
    model = TR.make_estimator(family, params, n_rows=df.count()).fit(df)
    out = TR.predict_with_proba(model, df)
    return out.select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias(
        "prediction"), F.transform("proba", lambda x: r6(x)).alias("proba"))


@register("train_logistic")
def q_train_logistic(spark, sf):
    return _fit_predict(spark, sf, "logistic_regression", {"C": 1.0, "class_weight": "balanced"})


@register("train_tree")
def q_train_tree(spark, sf):
    return _fit_predict(spark, sf, "decision_tree", {"max_depth": 5, "min_samples_leaf": 2, "class_weight": None})


@register("train_forest")
def q_train_forest(spark, sf):
    return _fit_predict(spark, sf, "random_forest", {"n_estimators": 100, "max_depth": 5, "min_samples_leaf": 1,
                                                     "class_weight": "balanced"})


@register("train_boosted")
def q_train_boosted(spark, sf):
    return _fit_predict(spark, sf, "boosted_trees", {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1,
                                                     "subsample": 1.0, "colsample_bytree": 1.0})


@register("cross_validate")
def q_cross_validate(spark, sf):
    df = training_frame(spark, sf)
    _, res = TR.cross_validate(df, "logistic_regression", TR.grid_candidates("logistic_regression", "fast"),
                               parallelism=4)
    return res.select("candidate", "params", r6("mean_test_f1_macro").alias("mean_test_f1_macro"),
                      "rank_test_f1_macro")


@register("write_cv_results")
def q_write_cv_results(spark, sf):
    df = training_frame(spark, sf)
    _, res = TR.cross_validate(df, "decision_tree", TR.grid_candidates("decision_tree", "fast"), parallelism=4,
                               labels=[0.0, 1.0, 2.0], all_scores=True)
    path = scratch_path(spark, "cv-results")
    A.write_cv_results(res, path)
    return spark.read.parquet(path)


@register("log_run")
def q_log_run(spark, sf):
    """Run params / prefixed metrics rows for a fitted model, appended to the long tables."""
    df = training_frame(spark, sf)
    params = {"C": 1.0, "class_weight": "balanced"}
    model = TR.make_estimator("logistic_regression", params, n_rows=df.count()).fit(df)
    pred = TR.predict_with_proba(model, df)
    m = G.classification_metrics(pred, "label", "prediction", "proba", [0.0, 1.0, 2.0]).collect()[0].asDict()
    metrics = {k: v for k, v in m.items() if isinstance(v, float)}
    p_rows, m_rows = R.log_run("run-embeddings-lr", params, metrics, spark, prefix="validation_")
    base = scratch_path(spark, "runs")
    p_rows.write.mode("append").parquet(base + "/run_params")
    m_rows.write.mode("append").parquet(base + "/run_metrics")
    return spark.read.parquet(base + "/run_metrics").select("run_id", "metric", r6("value").alias("value"))


def _scoring_model(spark, sf):
    li = lineitem_frame(spark, sf)
    train = li.where(F.col("l_shipdate") < F.lit(TRAIN_CUT).cast("timestamp_ntz"))
    params = P.fit_preparation(train, LI_FEATURES)
    p = {r["feature"]: r.asDict() for r in params.collect()}
    y = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    prepared = P.apply_preparation(train.withColumn("label", y), p, LI_FEATURES, keep=["label"])
    vec = TR.assemble(prepared, LI_FEATURES)
    model = TR.make_estimator("logistic_regression", {"C": 1.0}, n_rows=vec.count()).fit(vec)
    return li, params, model


@register("score_batch")
def q_score_batch(spark, sf):
    li, params, model = _scoring_model(spark, sf)
    scored = S.score_batch(li, model, params, LI_FEATURES, model_name="classifier", model_version="1",
                           model_alias="champion", keep=LI_KEY)
    return scored.withColumn("probabilities", F.to_json("probabilities"))


@register("persist_fitted")
def q_persist_fitted(spark, sf):
    """Save params + model, reload both, score again: rows where the reloaded scoring differs."""
    li, params, model = _scoring_model(spark, sf)
    base = scratch_path(spark, "fitted")
    A.save_params(params, base + "/params")
    model.write().overwrite().save(base + "/model")
    from pyspark.ml.classification import LogisticRegressionModel
    params2 = A.load_params(spark, base + "/params")
    model2 = LogisticRegressionModel.load(base + "/model")
    a = S.score_batch(li, model, params, LI_FEATURES, keep=LI_KEY).select(*LI_KEY, "predicted_class")
    b = S.score_batch(li, model2, params2, LI_FEATURES, keep=LI_KEY).select(*LI_KEY, F.col("predicted_class").alias("p2"))
    return a.join(b, LI_KEY).select(*LI_KEY, "predicted_class", (F.col("predicted_class") == F.col("p2")).alias("same"))


@register("evaluate_split")
def q_evaluate_split(spark, sf):
    """Confusion matrix, report, ROC points, AUC and metrics of a model on the fold it has not seen."""
    df = training_frame(spark, sf)
    model = TR.make_estimator("logistic_regression", {"C": 1.0, "class_weight": None}, n_rows=df.count()).fit(
        df.where(F.col("fold") != 0))
    pred = TR.score_models(df.where(F.col("fold") == 0), [model], ["label"])
    out = G.evaluate_split(pred, "label", "prediction", "proba", [0.0, 1.0, 2.0], {0: "low", 1: "medium", 2: "high"})
    return out.select("section", "key", "class", r6("x").alias("x"), r6("value").alias("value"))


STORED = {"logistic_regression": {"C": 1.0, "class_weight": "balanced"}, "decision_tree": {"max_depth": 5, "min_samples_leaf": 2},
          "random_forest": {"n_estimators": 20, "max_depth": 5}, "boosted_trees": {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1}}


@register("check_reproducible_models", " UNION ALL ".join(
    f"SELECT '{f}' AS family, count(*) AS rows, CAST(0 AS BIGINT) AS refit_differs, CAST(0 AS BIGINT) AS reloaded_differs FROM embeddings"
    for f in STORED))
def q_check_reproducible_models(spark, sf):
    """For every family, rows whose prediction differs after a second fit with the same seed, or
    after saving and loading the model."""
    from tabwatch.operators.checks import prediction_differences
    df = materialize(training_frame(spark, sf).select("vec_id", "features", "label", "weight"))
    n, out = df.count(), None
    for family, params in STORED.items():
        model = TR.fit_one(df, family, params, n)
        path = scratch_path(spark, f"stored-{family}")
        A.save_model(spark, model, path, family, params, ["embedding"], [0, 1, 2])
        others = {"refit": TR.fit_one(df, family, params, n), "reloaded": A.load_model(spark, path)[0]}
        row = prediction_differences(df, model, others, ["vec_id"]).select(F.lit(family).alias("family"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@register("train_and_select")
def q_train_and_select(spark, sf):
    """The composed job on the embeddings (three classes), logistic regression and trees on the
    whole fast grid; the comparison with the champion's version and alias."""
    from tabwatch.plans.jobs import train_and_select
    lab = F.when(F.col("label") <= 2, 0.0).when(F.col("label") <= 5, 1.0).otherwise(2.0)
    splits = P.stratified_split(table(spark, sf, "embeddings").select("vec_id", "embedding", lab.alias("label")), "label", ["vec_id"])
    # forests and boosted trees are left to the caller: see README for what their grids cost
    got = train_and_select(splits, ["embedding"], "label", scratch_path(spark, "training"), "2024-01-31 00:00:00", key=["vec_id"],
                           families=("logistic_regression", "decision_tree"))
    return got.select("model_name", *[r6(c).alias(c) for c, t in got.dtypes if t == "double"], "best_params", "run_id", "version", "alias")
