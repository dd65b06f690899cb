"""Training, cross-validation, the model store and the composed training job."""

import pytest

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabwatch.operators import train as TR
from tabwatch.operators.prepare import stratified_split
from tabwatch.plans.q_train import training_frame
from tabwatch.sources import files as A


def test_grid_sizes():
    fast = sum(len(TR.grid_candidates(f, "fast")) for f in TR.PARAM_GRIDS["fast"])
    full = sum(len(TR.grid_candidates(f, "full")) for f in TR.PARAM_GRIDS["full"])
    assert (fast, full) == (118, 622)


def test_cv_scores_match_evaluator(spark):
    """The grouped scores of all models agree with one evaluation a model, on folds with their own weights."""
    df = training_frame(spark, SF_SMALL)
    cands = [{"C": 0.1, "class_weight": None}, {"C": 10.0, "class_weight": "balanced"}]
    _, full = TR.cross_validate(df, "logistic_regression", cands, parallelism=2, labels=[0.0, 1.0, 2.0], all_scores=True)
    _, plain = TR.cross_validate(df, "logistic_regression", cands, parallelism=2)
    want = []
    for c in cands:
        scores = []
        for f in range(3):
            train = TR.balanced_weights(df.where(F.col("fold") != f), "label")
            model = TR.make_estimator("logistic_regression", c, n_rows=train.count()).fit(train)
            scores.append(TR.MacroF1Evaluator().evaluate(model.transform(df.where(F.col("fold") == f))))
        want.append(sum(scores) / 3)
    for res in (full, plain):
        got = {r.candidate: r for r in res.collect()}
        assert [got[i].mean_test_f1_macro for i in range(2)] == pytest.approx(want, abs=1e-12)
        assert sorted(r.rank_test_f1_macro for r in got.values()) == [1, 2]


@pytest.mark.parametrize("family,params", [("decision_tree", {"max_depth": 3}), ("random_forest", {"n_estimators": 5, "max_depth": 3}),
                                           ("boosted_trees", {"n_estimators": 3, "max_depth": 2, "learning_rate": 0.1})])
def test_models_score_as_one_projection_as_they_do_alone(spark, family, params):
    df = training_frame(spark, SF_SMALL)
    model = TR.fit_one(df, family, params, df.count())
    both = TR.score_models(df, [model, model], ["vec_id"]).collect()
    alone = {r.vec_id: r for r in TR.predict_with_proba(model, df).collect()}
    assert len(both) == 2 * len(alone) and {r.model for r in both} == {0, 1}
    for r in both:
        assert r.prediction == alone[r.vec_id].prediction and r.proba == pytest.approx(alone[r.vec_id].proba)


def test_any_family_is_saved_and_loaded(spark, tmp_path):
    df = training_frame(spark, SF_SMALL)
    for family, params in {"logistic_regression": {"C": 1.0}, "decision_tree": {"max_depth": 3}, "random_forest": {"n_estimators": 3, "max_depth": 3},
                           "boosted_trees": {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1}}.items():
        model = TR.fit_one(df, family, params, df.count())
        A.save_model(spark, model, f"{tmp_path}/{family}", family, params, ["embedding"], [0, 1, 2])
        again, manifest = A.load_model(spark, f"{tmp_path}/{family}")
        assert manifest["params"] == params and manifest["labels"] == [0.0, 1.0, 2.0] and type(again) is type(model)
        a, b = (sorted(map(str, TR.score_models(df, [m], ["vec_id"]).collect())) for m in (model, again))
        assert a == b


SMALL_GRID = {"logistic_regression": {"C": [0.1, 10.0]}, "decision_tree": {"max_depth": [2, 4], "min_samples_split": [2, 5]},
              "random_forest": {"n_estimators": [3], "max_depth": [2, 3]}, "boosted_trees": {"n_estimators": [2], "max_depth": [2], "learning_rate": [0.1]}}


def test_training_job_resumes_and_selects(spark, tmp_path, monkeypatch):
    """Stopped after two lots, started again: nothing is fitted twice, every table is there, one champion."""
    from tabwatch.plans import jobs as J

    monkeypatch.setitem(TR.PARAM_GRIDS, "tiny", SMALL_GRID)
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("label") <= 4, 0.0).otherwise(1.0).alias("label"))
    splits = stratified_split(e, "label", ["vec_id"])
    out = str(tmp_path / "run")
    run = lambda: J.train_and_select(splits, ["embedding"], "label", out, "2024-01-01 00:00:00", grid="tiny", key=["vec_id"], together=1)
    scored, cv_scores = [], TR.cv_scores

    def stopping(df, family, fits, *args, **kw):
        if len(scored) == 3:
            raise KeyboardInterrupt
        scored.append((family, *fits))
        return cv_scores(df, family, fits, *args, **kw)

    monkeypatch.setattr(TR, "cv_scores", stopping)
    with pytest.raises(KeyboardInterrupt):
        run()
    first, scored[:] = list(scored), []
    monkeypatch.setattr(TR, "cv_scores", lambda df, family, fits, *a, **kw: scored.append((family, *fits)) or cv_scores(df, family, fits, *a, **kw))
    got = {r.model_name: r for r in run().collect()}
    fits = [("logistic_regression", 0), ("logistic_regression", 1), ("decision_tree", 0), ("decision_tree", 1), ("random_forest", 0),
            ("random_forest", 1), ("boosted_trees", 0)]
    assert first + scored == fits
    assert set(got) == set(J.FAMILIES) and [r.alias for r in got.values()].count("champion") == 1
    best = max(r.validation_f1_macro for r in got.values())
    champion = next(r for r in got.values() if r.alias)
    assert champion.validation_f1_macro == best and champion.version == 1
    assert champion.model_name == next(f for f in J.FAMILIES if got[f].validation_f1_macro == best)
    cv = spark.read.parquet(f"{out}/cv_results").groupBy("family").count().collect()
    assert {r.family: r["count"] for r in cv} == {"logistic_regression": 2, "decision_tree": 4, "random_forest": 2, "boosted_trees": 1}
    # the written tables tell the same as the comparison
    metrics = {(r.run_id, r.metric): r.value for r in spark.read.parquet(f"{out}/run_metrics").collect()}
    for r in got.values():
        assert metrics[r.run_id, "test_accuracy"] == r.test_accuracy and metrics[r.run_id, "best_cv_f1_macro"] == r.best_cv_f1_macro
        test = stratified_split(e, "label", ["vec_id"]).where("split = 'test'")
        model, _ = A.load_model(spark, f"{out}/models/{r.run_id}")
        pred = TR.score_models(TR.assemble(test, ["embedding"]), [model], ["label"])
        assert pred.where("label = prediction").count() / pred.count() == pytest.approx(r.test_accuracy)
    # a third run does nothing new and registers nothing twice
    scored[:] = []
    again = {r.model_name: r for r in run().collect()}
    assert again == got and scored == [] and spark.read.parquet(f"{out}/model_versions").count() == 1


def test_bindings_train_what_the_grid_says(monkeypatch):
    """write_cv_results runs every candidate of the tree grid, train_boosted a member of its grid."""
    from tabwatch.plans import q_train

    class Stop(Exception):
        pass

    asked = []

    def stop(*args, **kw):
        asked.append(args)
        raise Stop

    monkeypatch.setattr(q_train, "training_frame", lambda spark, sf: None)
    monkeypatch.setattr(q_train, "_fit_predict", stop)
    monkeypatch.setattr(TR, "cross_validate", stop)
    for q in (q_train.q_write_cv_results, q_train.q_train_boosted):
        with pytest.raises(Stop):
            q(None, SF_SMALL)
    assert asked[0][1:3] == ("decision_tree", TR.grid_candidates("decision_tree", "fast"))
    assert asked[1][2:] == ("boosted_trees", asked[1][3]) and asked[1][3] in TR.grid_candidates("boosted_trees", "fast")


def test_equal_estimators_are_fitted_once_and_all_reported(spark, monkeypatch):
    fitted, cv = [], TR.cv_scores
    monkeypatch.setattr(TR, "cv_scores", lambda df, family, fits, *args: fitted.append(len(fits)) or cv(df, family, fits, *args))
    cands = [{"max_depth": 3, "min_samples_split": s, "min_samples_leaf": 1, "class_weight": w} for s in (2, 5) for w in (None, "balanced")]
    _, res = TR.cross_validate(training_frame(spark, SF_SMALL), "decision_tree", cands, labels=[0.0, 1.0, 2.0], all_scores=True)
    rows = {r.candidate: r for r in res.collect()}
    scores = lambda r: [v for k, v in r.asDict().items() if k not in ("candidate", "params")]
    assert fitted == [2] and sorted(rows) == [0, 1, 2, 3] and [rows[k].params for k in range(4)] == [str(c) for c in cands]
    assert scores(rows[0]) == scores(rows[2]) and scores(rows[1]) == scores(rows[3])
    assert {r.rank_test_f1_macro for r in rows.values()} in ({1, 3}, {1})


def test_fits_run_on_few_partitions_whatever_the_shuffles_are(spark, monkeypatch):
    """The partitions of a fit follow the bytes of the features and the cores, not the shuffle partitions."""
    monkeypatch.setattr(TR, "LEAST_BYTES", 64 * 8 * 10)
    cores, shuffles, seen = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        df = training_frame(spark, SF_SMALL)
        assert TR.dealt(df).rdd.getNumPartitions() == min(cores, 50) and TR.dealt(df, at_once=cores).rdd.getNumPartitions() == 1
        assert TR.dealt(df.limit(0)).count() == 0 and TR.dealt(df).count() == df.count()
        fit = TR.fit_one
        monkeypatch.setattr(TR, "fit_one", lambda rows, *a, **kw: seen.append(rows.rdd.getNumPartitions()) or fit(rows, *a, **kw))
        TR.cross_validate(df, "decision_tree", [{"max_depth": 2}], labels=[0.0, 1.0, 2.0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) == 4 and max(seen) <= -(-cores // 4)


def test_fits_of_equal_scores_share_a_rank_in_any_order_of_rows(spark):
    """The mean of 0.1, 0.2 and 0.3 has another last bit when it is summed in another order."""
    rows = [(fit, fold, part, *[x] * len(TR.CV_METRICS)) for part in ("test", "train") for fold, x in enumerate((0.1, 0.2, 0.3)) for fit in (0, 1)]
    rows.sort(key=lambda r: (r[0], r[1] if r[0] else -r[1]))
    res = TR.summarise_scores(spark.createDataFrame(rows, TR.SCORES), [{"a": 0}, {"a": 1}], [0, 1]).collect()
    assert len({r.mean_test_f1_macro for r in res}) == 1 and [r.rank_test_f1_macro for r in res] == [1, 1]


def test_macro_means_do_not_depend_on_the_order_of_the_classes(spark):
    from tabwatch.operators.evaluate import _summary

    orders = ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.2, 0.3, 0.1))
    rows = [(g, c, 1, 2, 1, x, x, x) for g, order in enumerate(orders) for c, x in enumerate(order)]
    stats = spark.createDataFrame(rows, "g int, class int, tp long, support long, predicted_count long, precision double, recall double, f1 double")
    got = _summary(stats.coalesce(1), ["g"]).collect()
    assert len(got) == 3 and len({(r.f1_macro, r.precision_macro, r.recall_macro) for r in got}) == 1


def test_deep_trees_are_held_a_few_at_a_time(spark, monkeypatch):
    """The driver holds trees up to a number of nodes, not those of all candidates; the scores are the same."""
    cands = [{"max_depth": d, "min_samples_leaf": leaf} for d in (2, None) for leaf in (1, 2, 3)]
    df = training_frame(spark, SF_SMALL)

    def cv():
        rows = TR.cross_validate(df, "decision_tree", cands, labels=[0.0, 1.0, 2.0], all_scores=True)[1].drop("params").collect()
        return {(r.candidate, k): v for r in rows for k, v in r.asDict().items()}

    want, held, at_once, score, fit = cv(), [], [], TR.score_models, TR.fit_one
    monkeypatch.setattr(TR, "HELD", 150, raising=False)
    monkeypatch.setattr(TR, "GROWING", 1000, raising=False)
    monkeypatch.setattr(TR, "score_models", lambda rows, models, *a, **kw: held.append([m.numNodes for m in models]) or score(rows, models, *a, **kw))
    growing = []

    def one(*a, **kw):
        growing.append(1)
        at_once.append(len(growing))
        try:
            return fit(*a, **kw)
        finally:
            growing.pop()

    monkeypatch.setattr(TR, "fit_one", one)
    assert cv() == pytest.approx(want, abs=1e-12)
    assert sum(map(len, held)) == 3 * len(cands) and len(held) > 1
    assert all(sum(h[:-1]) < 150 for h in held)  # the last one made them too many
    assert max(at_once) == 1


def test_deep_trees_keep_node_ids_and_are_the_same(spark):
    df = training_frame(spark, SF_SMALL).persist()
    deep = TR.make_estimator("decision_tree", {"max_depth": None})
    told = lambda e: e.fit(df).toDebugString.split("\n", 1)[1]
    assert deep.getCacheNodeIds() and not TR.make_estimator("decision_tree", {"max_depth": 5}).getCacheNodeIds()
    assert told(deep) == told(deep.copy().setCacheNodeIds(False))
    df.unpersist()
