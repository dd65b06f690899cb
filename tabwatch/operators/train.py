"""Model training and selection with Spark ML.

Families: multinomial logistic regression, decision tree, random forest, boosted trees
(one-vs-rest over binary GBT, since Spark GBT is binary). Cross-validation runs over an explicit
stratified fold column (E1): a chunk of candidates is fitted on every fold, all its models score
the rows in one pass, and one grouped evaluation gives the five scores of all.
"""

from __future__ import annotations

import functools
import itertools
import math
from multiprocessing.pool import ThreadPool

from pyspark.ml import Estimator
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest,
                                       OneVsRestModel, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.operators.evaluate import classification_metrics, confusion_counts
from tabwatch.session import materialize

# Hyper-parameter grids (fixed values). None depth = unlimited (mapped to Spark's maximum 30).
PARAM_GRIDS = {
    "fast": {
        "logistic_regression": {"C": [0.1, 1.0, 10.0], "class_weight": [None, "balanced"]},
        "decision_tree": {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2],
                          "class_weight": [None, "balanced"]},
        "random_forest": {"n_estimators": [100, 200], "max_depth": [5, 10, None], "min_samples_split": [2, 5],
                          "min_samples_leaf": [1, 2], "class_weight": [None, "balanced"]},
        "boosted_trees": {"n_estimators": [100, 200], "max_depth": [3, 5], "learning_rate": [0.05, 0.1],
                          "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0]},
    },
    "full": {
        "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0], "class_weight": [None, "balanced"]},
        "decision_tree": {"max_depth": [3, 5, 10, 15, None], "min_samples_split": [2, 5, 10],
                          "min_samples_leaf": [1, 2, 4], "criterion": ["gini", "entropy"],
                          "class_weight": [None, "balanced"]},
        "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [5, 10, 20, None],
                          "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                          "class_weight": [None, "balanced"]},
        "boosted_trees": {"n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.03, 0.05, 0.1],
                          "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "reg_lambda": [1.0, 2.0]},
    },
}
MAX_DEPTH = 30
#: Deeper trees keep the node of every row on the executors; else each step of a fit sends the tree so far.
DEEP = 12


def grid_candidates(family: str, size: str = "fast") -> list[dict]:
    """The cartesian product of a family's grid (fast: 6+32+48+32 = 118, full: 622)."""
    g = PARAM_GRIDS[size][family]
    keys = list(g)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[g[k] for k in keys])]


def balanced_weights(df: DataFrame, label: str, weight_col: str = "weight", in_place: bool = False) -> DataFrame:
    """Class weight n / (k * n_c) joined onto every row (k = number of classes present).

    ``in_place``: the rows stay in their partitions, the weights (one row a class) go to them.
    """
    df = df.drop(weight_col)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    weights = counts.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(weights) if in_place else weights, label, "left")


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """Feature columns (or one array column) -> ML vector."""
    feats = list(features)
    if len(feats) == 1 and dict(df.dtypes)[feats[0]].startswith("array"):
        return df.withColumn(out, array_to_vector(F.col(feats[0]).cast("array<double>")))
    return VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="keep").transform(df)


#: Bytes of feature values in a partition of training rows: at most, and at least where cores are to be kept busy.
MOST_BYTES = 64 << 20
LEAST_BYTES = 1 << 20


def dealt(df: DataFrame, features: str = "features", at_once: int = 1) -> DataFrame:
    """Training rows dealt evenly over as few partitions as keep the cores busy under ``at_once`` fits at a time.

    Every step of a fit sums its statistics once in each partition (a deep tree: 32 bins of every feature
    for every open node) and every task reports to the driver, so the cost of a fit grows with the partitions.
    Their number follows the bytes of the features, not the shuffle partitions of what made the rows.
    """
    first = df.select(features).first()
    if first is None:
        return df
    size = df.count() * len(first[0]) * 8
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(size / MOST_BYTES), min(math.ceil(cores / at_once), math.ceil(size / LEAST_BYTES))))


def make_estimator(family: str, params: dict, label: str = "label", features: str = "features",
                   n_rows: int | None = None, seed: int = 42, weight_col: str = "weight") -> Estimator:
    """A Spark ML estimator for one candidate (parameter names mapped from the grid)."""
    wc = weight_col if params.get("class_weight") == "balanced" else ""
    depth = params.get("max_depth")
    depth = MAX_DEPTH if depth is None else int(depth)
    leaf = int(params.get("min_samples_leaf", 1))
    if family == "logistic_regression":
        # The grid's C scales a summed loss; Spark's loss is a mean: regParam = 1 / (C * n).
        reg = 1.0 / (float(params["C"]) * float(n_rows or 1))
        return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=reg,
                                  elasticNetParam=0.0, maxIter=3000, standardization=False, weightCol=wc)
    if family == "decision_tree":
        return DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=depth, minInstancesPerNode=leaf,
                                      impurity=params.get("criterion", "gini"), seed=seed, weightCol=wc, cacheNodeIds=depth > DEEP)
    if family == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=int(params["n_estimators"]),
                                      maxDepth=depth, minInstancesPerNode=leaf, seed=seed, weightCol=wc, cacheNodeIds=depth > DEEP)
    if family == "boosted_trees":
        colsample = float(params.get("colsample_bytree", 1.0))
        gbt = GBTClassifier(maxIter=int(params["n_estimators"]), maxDepth=depth, stepSize=float(params["learning_rate"]),
                            subsamplingRate=float(params.get("subsample", 1.0)),
                            featureSubsetStrategy="all" if colsample >= 1.0 else str(colsample), seed=seed)
        return OneVsRest(classifier=gbt, featuresCol=features, labelCol=label)
    raise ValueError(f"unknown model family {family!r}")


def predict_with_proba(model, df: DataFrame, features: str = "features", n_classes: int | None = None) -> DataFrame:
    """Predictions with ``proba`` (array<double>). One-vs-rest GBT emits raw margins only: the
    per-class probability is the member's sigmoid 1 / (1 + exp(-2 margin)), then normalised."""
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn("proba", vector_to_array("probability"))
    raw = vector_to_array("rawPrediction")
    sig = F.transform(raw, lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(sig, F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("proba", F.transform(sig, lambda x: x / total))


def macro_f1_from_counts(cells) -> float:
    """Macro F1 over actual U predicted classes, zero_division = 0, from (actual, predicted, count)."""
    tp, support, predicted = {}, {}, {}
    for a, p, c in cells:
        support[a] = support.get(a, 0) + c
        predicted[p] = predicted.get(p, 0) + c
        if a == p:
            tp[a] = tp.get(a, 0) + c
    classes = set(support) | set(predicted)
    if not classes:
        return 0.0
    f1 = [2.0 * tp.get(k, 0) / (support.get(k, 0) + predicted.get(k, 0)) if support.get(k, 0) + predicted.get(k, 0)
          else 0.0 for k in classes]
    return sum(f1) / len(f1)


class MacroF1Evaluator(Evaluator):
    """Macro F1 (zero_division = 0, labels = actual U predicted) from confusion counts."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol = labelCol
        self.predictionCol = predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        # One aggregation; its result has at most (#classes)^2 rows, so the F1 arithmetic is local.
        rows = confusion_counts(dataset, self.labelCol, self.predictionCol).collect()
        return macro_f1_from_counts((r["actual"], r["predicted"], r["count"]) for r in rows)

    def isLargerBetter(self) -> bool:
        return True


CV_METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "roc_auc_ovr_weighted")
#: Candidates whose models are fitted, scored and let go together.
TOGETHER = 12
#: Nodes that trees which grow at the same time may come to, and nodes of fitted trees that wait to score the
#: rows: the driver holds both, and sends the waiting ones as one task.
GROWING = 1 << 20
HELD = 1 << 18
SCORES = "fit int, fold int, part string, " + ", ".join(f"{m} double" for m in CV_METRICS)


def distinct_fits(family: str, candidates: list[dict]) -> tuple[list[dict], list[int]]:
    """Candidates that make the same estimator (an option Spark does not have) share one fit:
    the parameters of each fit, and the fit of each candidate."""
    first, fits, fit_of = {}, [], []
    for c in candidates:
        e = make_estimator(family, c, n_rows=1)
        own = e.getClassifier() if isinstance(e, OneVsRest) else e
        key = repr(sorted((p.name, v) for p, v in own.extractParamMap().items()))
        if key not in first:
            first[key] = len(fits)
            fits.append(c)
        fit_of.append(first[key])
    return fits, fit_of


def fit_one(df: DataFrame, family: str, params: dict, n_rows: int, label: str = "label", features: str = "features",
            weight_col: str = "weight", seed: int = 42):
    """One fitted model of a family."""
    return make_estimator(family, params, label, features, n_rows, seed, weight_col).fit(df)


def score_models(df: DataFrame, models: list, keep, features: str = "features") -> DataFrame:
    """(keep..., model, prediction, proba) of every row under every model, from one pass over the rows:
    the models are columns of one projection, then one row each."""
    rows, cells = df, []
    for i, m in enumerate(models):
        members = m.models if isinstance(m, OneVsRestModel) else [m]
        for k, member in enumerate(members):
            own = member.copy()
            own.setFeaturesCol(features)
            own.setPredictionCol("")
            own.setProbabilityCol("" if len(members) > 1 else f"_q{i}")
            own.setRawPredictionCol(f"_r{i}_{k}" if len(members) > 1 else "")
            rows = own.transform(rows)
        if len(members) > 1:  # one-vs-rest: the members' sigmoids, normalised
            sig = [1.0 / (1.0 + F.exp(-2.0 * vector_to_array(f"_r{i}_{k}")[1])) for k in range(len(members))]
            rows = rows.withColumn(f"_s{i}", F.array(*sig))
            total = functools.reduce(lambda a, b: a + b, [F.col(f"_s{i}")[k] for k in range(len(members))])
            proba = F.array(*[F.col(f"_s{i}")[k] / total for k in range(len(members))])
        else:
            proba = vector_to_array(f"_q{i}")
        rows = rows.withColumn(f"_p{i}", proba)
        best = (F.array_position(f"_p{i}", F.array_max(f"_p{i}")) - 1).cast("double")  # the first of the largest
        cells.append(F.struct(F.lit(i).alias("model"), best.alias("prediction"), F.col(f"_p{i}").alias("proba")))
    return rows.select(*keep, F.inline(F.array(*cells)))


def most_nodes(family: str, params: dict, n_rows: int) -> int:
    """Nodes that the trees of a fit can have at most (0: no trees)."""
    if family == "logistic_regression":
        return 0
    depth = params.get("max_depth")
    one = min(2 ** ((MAX_DEPTH if depth is None else int(depth)) + 1), 2 * n_rows // int(params.get("min_samples_leaf", 1)) + 1)
    return one * int(params.get("n_estimators", 1))


def held_nodes(model) -> int:
    """Nodes of the trees of a fitted model."""
    if isinstance(model, OneVsRestModel):
        return sum(held_nodes(m) for m in model.models)
    return getattr(model, "totalNumNodes", None) or getattr(model, "numNodes", 0)


def cv_scores(df: DataFrame, family: str, fits: dict[int, dict], folds: int, labels, label: str = "label", features: str = "features",
              fold_col: str = "fold", parallelism: int = 4, seed: int = 42) -> DataFrame:
    """(fit, fold, part, five scores) of some candidates' fits on every fold: written results, no model is kept.

    A fold's fit sees its training folds only: class weights and the penalty follow from their
    counts. As many models as the driver may hold score the rows in one pass; the scores of all of
    them are one grouped evaluation by (model, part).
    """
    jobs, parts = [], []
    for f in range(folds):
        train = balanced_weights(df.where(F.col(fold_col) != f), label, in_place=True).persist()
        n = train.count()
        parts.append(train)
        jobs += [(i, f, train, params, n) for i, params in fits.items()]
    rows, held, nodes = [], [], 0
    most = max(most_nodes(family, params, n) for _, _, _, params, n in jobs)
    at_once = max(1, min(parallelism, GROWING // max(1, most)))
    step = max(at_once, HELD // max(1, most))
    try:
        with ThreadPool(at_once) as pool:
            for at in range(0, len(jobs), step):
                own = jobs[at:at + step]
                models = pool.map(lambda j: fit_one(j[2], family, j[3], j[4], label, features, seed=seed), own)
                held += [(i, f, m) for (i, f, _, _, _), m in zip(own, models)]
                nodes += sum(held_nodes(m) for m in models)
                del models  # of a step that is over, else one more is held while the next fits
                if nodes >= HELD or at + step >= len(jobs):
                    rows += _scores_of(df, held, labels, label, features, fold_col)
                    held, nodes = [], 0
    finally:
        for p in parts:
            p.unpersist()
    return df.sparkSession.createDataFrame(rows, SCORES)


def _scores_of(df: DataFrame, held: list, labels, label: str, features: str, fold_col: str) -> list[tuple]:
    """Rows of ``SCORES`` of the (fit, fold, model) that are held."""
    scored = score_models(df, [m for _, _, m in held], [label, fold_col], features)
    test = F.element_at(F.array(*[F.lit(f) for _, f, _ in held]), F.col("model") + 1) == F.col(fold_col)
    scored = scored.select(F.col("model").alias("_model"), F.when(test, "test").otherwise("train").alias("part"), label, "prediction", "proba")
    # written: the plan of kept rows holds the models, and every later step would send them again
    met = classification_metrics(materialize(scored), label, "prediction", "proba", labels, by=["_model", "part"]).collect()  # two rows a model
    return [(*held[r["_model"]][:2], r["part"], *[r[m] for m in CV_METRICS]) for r in met]


def summarise_scores(scores: DataFrame, candidates: list[dict], fit_of: list[int]) -> DataFrame:
    """(candidate, params, mean_/std_{test,train}_<score>, rank_test_f1_macro): one row a candidate, min rank on ties."""
    from tabwatch.operators.registry import rank_candidates

    # a few rows; in the order of the folds, so that equal scores have equal means and share a rank
    scores = scores.coalesce(1).sortWithinPartitions("fit", "part", "fold")
    means = scores.groupBy("fit").agg(*[
        f(F.when(F.col("part") == part, F.col(m))).alias(f"{name}_{part}_{m}")
        for part in ("test", "train") for name, f in (("mean", F.avg), ("std", F.stddev_pop)) for m in CV_METRICS])
    names = df_of(scores.sparkSession, [(i, str(c), k) for i, (c, k) in enumerate(zip(candidates, fit_of))], "candidate int, params string, fit int")
    return rank_candidates(names.join(means, "fit").drop("fit"), "mean_test_f1_macro", rank_col="rank_test_f1_macro", buckets=1)


def df_of(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def best_candidate(results: DataFrame) -> int:
    """The first of the candidates with the highest mean macro-F1 on the test folds."""
    return results.orderBy("rank_test_f1_macro", "candidate").first()["candidate"]


def cross_validate(df: DataFrame, family: str, candidates: list[dict], label: str = "label",
                   features: str = "features", fold_col: str = "fold", parallelism: int = 4, seed: int = 42,
                   labels=None, all_scores: bool = False):
    """CV over the candidates with the given folds (E1); refit the best mean macro-F1 on all rows.

    Returns (best_model, results). results: one row per candidate with ``params``, ``mean_test_f1_macro``
    and ``rank_test_f1_macro`` (min rank on ties); with ``all_scores`` mean / std of the five scores on
    the test and on the training folds.
    """
    # every fit and every score reads the training frame: its plan is cut, its rows are kept meanwhile
    df = dealt(materialize(df), features, parallelism).persist()
    try:
        folds = df.agg(F.max(fold_col)).first()[0] + 1
        labels = labels if labels is not None else sorted(r[0] for r in df.select(label).distinct().collect())  # the class list (small)
        fits, fit_of = distinct_fits(family, candidates)
        rows = []
        for at in range(0, len(fits), TOGETHER):
            own = dict(list(enumerate(fits))[at:at + TOGETHER])
            rows += cv_scores(df, family, own, folds, labels, label, features, fold_col, parallelism, seed).collect()
        res = summarise_scores(df_of(df.sparkSession, rows, SCORES), candidates, fit_of)
        if not all_scores:
            res = res.select("candidate", "params", "mean_test_f1_macro", "rank_test_f1_macro")
        model = fit_one(balanced_weights(df, label, in_place=True), family, candidates[best_candidate(res)], df.count(), label, features, seed=seed)
    finally:
        df.unpersist()
    return model, res


def training_summary(name: str, f1: float, run_id: str, path: str) -> dict:
    """E12."""
    return {"best_model_name": name, "best_validation_f1_macro": f1, "best_run_id": run_id, "model_path": path}
