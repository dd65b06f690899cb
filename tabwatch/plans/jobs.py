"""Composed jobs: the preparation run (C11), training and selection (E2-E14) and the daily monitoring run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwatch.functions.columns import hash_order
from tabwatch.operators import clean as B
from tabwatch.operators import evaluate as G
from tabwatch.operators import monitor as M
from tabwatch.operators import prepare as P
from tabwatch.operators import registry as R
from tabwatch.operators import train as TR
from tabwatch.session import materialize
from tabwatch.sources import files as A
from tabwatch.spec import DEFAULT_LABEL_RULES, DriftConfig, PerformanceConfig, PreparationConfig


PREPARATION_REPORT = T.StructType([T.StructField("section", T.StringType()), T.StructField("key", T.StringType()),
                                   T.StructField("value", T.DoubleType())])


@dataclass
class PreparationResult:
    prepared: DataFrame      # scaled features + class + split
    params: DataFrame        # one row per feature
    report: DataFrame        # (section, key, value)


def run_preparation(spark: SparkSession, sources, columns, features, target: str, out_dir: str,
                    label_rules=DEFAULT_LABEL_RULES, config: PreparationConfig = PreparationConfig(),
                    tag_col: str = "source_tag", sep: str = ";") -> PreparationResult:
    """C11: read -> union -> rename -> coerce -> label -> drop invalid -> dedupe -> split -> fit on
    train -> apply everywhere -> write splits, params and report. ``sources`` = [(path, tag), ...].

    The deduplicated frame and the split are checkpointed to the shared folder (reused by the fit, the
    write and the report, and a lineage cut if executors are lost). Rows are unique after dedupe, so the split
    key is a hash of every column.
    """
    frames = [A.read_delimited(spark, path, columns, tag=tag, tag_col=tag_col, sep=sep) for path, tag in sources]
    raw = A.union_sources(*frames)
    mapping = B.snake_case_mapping(raw.columns)
    renamed = B.rename_columns(raw, mapping)
    feats = [mapping.get(c, c) for c in features]
    tgt = mapping.get(target, target)
    typed = B.coerce_numeric(renamed, feats, target=tgt)
    labelled = B.bucket_label(typed, tgt, label_rules)
    valid = B.drop_invalid_targets(labelled, [tgt, "quality_label", "quality_class"])
    groups = materialize(B.drop_exact_duplicates(valid, copies="_copies"))  # the sources are read and grouped once
    deduped = groups.drop("_copies")
    keyed = deduped.withColumn("_row_key", hash_order(config.split.seed, deduped.columns))
    splits = P.stratified_split(keyed, "quality_class", ["_row_key"], config.split)
    splits = materialize(splits.select(*feats, "quality_class", "split"))
    prepared, params = P.fit_transform_preparation(splits, feats, keep=["quality_class"],
                                                   multiplier=config.iqr_multiplier, scaling=config.scaling)
    A.write_splits(prepared, f"{out_dir}/splits", feats, "quality_class")
    A.save_params(params, f"{out_dir}/params")
    A.write_report(P.preparation_report(groups, deduped, splits, "quality_class", copies="_copies"), f"{out_dir}/report")
    report = A.read_report(spark, f"{out_dir}/report", PREPARATION_REPORT)
    # Downstream reads the written splits: no recomputation, and lineage is cut at the write.
    return PreparationResult(spark.read.parquet(f"{out_dir}/splits"), A.load_params(spark, f"{out_dir}/params"),
                             report)


def daily_monitoring(reference: DataFrame, events: DataFrame, features, asof, run_prefix: str = "run",
                     drift_cfg: DriftConfig = DriftConfig(), perf_cfg: PerformanceConfig = PerformanceConfig(),
                     features_col: str = "features", out_dir: str | None = None) -> DataFrame:
    """Drift (recent features vs reference) + rolling performance (latest feedback) ->
    two monitoring_runs rows and the retraining decision, as one small frame.

    ``events`` are prediction events with feedback attached (H3); features are JSON text.
    The drift row is skipped (status insufficient_samples) below the minimum sample. With ``out_dir``
    the rows are appended to its monitoring_runs and both reports are written beside it.
    """
    feats = list(features)
    recent = A.recent_features(events, asof, drift_cfg.lookback_days, drift_cfg.sample_limit)
    cur_long = B.expand_json_features(recent, features_col, ids=["prediction_id"]).where(F.col("feature").isin(feats))
    from tabwatch.functions.reshape import to_long
    ks = M.ks_two_sample_long(to_long(reference, feats), cur_long)
    det = M.drift_flags(ks, len(feats), drift_cfg)
    drift = M.drift_report(reference, recent, feats, drift_cfg, details=det, with_details=False)
    drift = materialize(M.drift_gate(drift, drift_cfg))  # one row, used by its run row, its report and the decision
    perf = materialize(M.rolling_performance(M.latest_feedback(events, config=perf_cfg), config=perf_cfg))
    d_row = A.monitoring_run_row(drift.where(F.col("status") == "ok").drop("status"), f"{run_prefix}-drift", asof,
                                 "drift")
    p_row = A.monitoring_run_row(perf, f"{run_prefix}-performance", asof, "performance")
    decision = M.retraining_decision(drift, perf, drift_cfg, perf_cfg)
    runs = d_row.unionByName(p_row)
    if out_dir is not None:
        A.append_monitoring_run(runs, f"{out_dir}/monitoring_runs")
        A.write_report(drift, f"{out_dir}/drift_report")
        A.write_report(perf, f"{out_dir}/performance_report")
    return runs.withColumn("_k", F.lit(1)).join(decision.select(
        F.col("retraining_required").alias("decision_retraining_required"),
        F.col("reason").alias("decision_reason")).withColumn("_k", F.lit(1)), "_k").drop("_k")


FAMILIES = ("logistic_regression", "decision_tree", "random_forest", "boosted_trees")
CANDIDATE_SCORES = "family string, params string, " + TR.SCORES
REPORT_ROWS = "run_id string, split string, section string, key string, class int, x double, value double"
RUN_METRICS = "run_id string, metric string, value double"
RUN_PARAMS = "run_id string, param string, value string"


def run_id_of(name: str, family: str, grid: str, folds: int, seed: int) -> str:
    """The same run has the same id, so a resumed job goes on with its own rows."""
    return hashlib.md5(f"{name}|{family}|{grid}|{folds}|{seed}".encode()).hexdigest()


def cross_validate_resumed(train: DataFrame, family: str, candidates: list[dict], out_dir: str, labels, folds: int, seed: int,
                           parallelism: int, together: int) -> DataFrame:
    """Scores of all fits of a family's candidates on every fold, in ``out_dir``/candidates.

    Fits are done ``together`` at a time; each lot is appended in one write when it is scored, and a
    job that starts again leaves out the fits that the table already holds for every fold.
    """
    spark = train.sparkSession
    path = f"{out_dir}/candidates"
    fits, _ = TR.distinct_fits(family, candidates)
    own = lambda: A.read_if_written(spark, path, CANDIDATE_SCORES).where(F.col("family") == family)
    seen = own().groupBy("fit").agg(F.countDistinct("fold", "part").alias("n")).where(F.col("n") == 2 * folds)
    done = {r["fit"] for r in seen.collect()}  # at most one row a fit
    todo = [i for i in range(len(fits)) if i not in done]
    for at in range(0, len(todo), together):
        lot = {i: fits[i] for i in todo[at:at + together]}
        scores = TR.cv_scores(train, family, lot, folds, labels, parallelism=parallelism, seed=seed)
        names = F.element_at(F.array(*[F.lit(json.dumps(p, sort_keys=True)) for p in fits]), F.col("fit") + 1)
        (scores.select(F.lit(family).alias("family"), names.alias("params"), *scores.columns).coalesce(1)
         .write.mode("append").parquet(path))
    return own().dropDuplicates(["fit", "fold", "part"]).drop("family", "params")


def train_and_select(splits: DataFrame, features, label: str, out_dir: str, created_at, grid: str = "fast", families=FAMILIES,
                     folds: int = 3, seed: int = 42, key=("row_id",), name: str = "classifier", alias: str = "champion",
                     parallelism: int = 8, together: int = TR.TOGETHER, split_col: str = "split") -> DataFrame:
    """Grid search of every family on the train split, refit, evaluation on the other splits,
    run tables, comparison, and registration of the champion.

    Written under ``out_dir`` (the shared folder): data, candidates (fit, fold, part, five scores), cv_results by
    family, models by run, run_params, run_metrics, reports (G11 of validation and test), comparison,
    model_versions, model_aliases, training_summary. A job that is started again goes on behind the
    last write: fits that have scores, models that have a manifest and runs that have metrics are not done
    again, and a run is registered once. Returns the comparison: one row a family, best first, with
    the version and alias of the champion (strictly highest validation macro-F1, the earlier family on ties).
    """
    spark = splits.sparkSession
    data_schema = "split string, fold int, label double, features array<double>"
    if not A.read_if_written(spark, f"{out_dir}/data/_done", "at string").take(1):
        rows = TR.assemble(splits, features).select(F.col(split_col).alias("split"), F.col(label).cast("double").alias("label"),
                                                    vector_to_array("features").alias("features"), *key)
        train = P.stratified_folds(rows.where("split = 'train'"), "label", list(key), k=folds, seed=seed)
        whole = train.unionByName(rows.where("split <> 'train'").withColumn("fold", F.lit(None).cast("int")))
        whole.select("split", "fold", "label", "features").write.mode("overwrite").parquet(f"{out_dir}/data/rows")
        spark.range(1).select(F.lit(str(created_at)).alias("at")).write.mode("overwrite").parquet(f"{out_dir}/data/_done")
    data = spark.read.schema(data_schema).parquet(f"{out_dir}/data/rows").withColumn("features", array_to_vector("features"))
    labels = sorted(r[0] for r in data.select("label").distinct().collect())  # the class list
    train = TR.dealt(data.where("split = 'train'").drop("split"), at_once=parallelism).persist()
    try:
        for family in families:
            run = run_id_of(name, family, grid, folds, seed)
            candidates = TR.grid_candidates(family, grid)
            _, fit_of = TR.distinct_fits(family, candidates)
            scores = cross_validate_resumed(train, family, candidates, out_dir, labels, folds, seed, parallelism, together)
            results = materialize(TR.summarise_scores(scores, candidates, fit_of))
            A.write_cv_results(results, f"{out_dir}/cv_results/family={family}")
            if A.read_if_written(spark, f"{out_dir}/run_metrics", RUN_METRICS).where(F.col("run_id") == run).take(1):
                continue
            best = results.orderBy("rank_test_f1_macro", "candidate").first()
            params = candidates[best["candidate"]]
            model = TR.fit_one(TR.balanced_weights(train, "label", in_place=True), family, params, train.count(), seed=seed)
            A.save_model(spark, model, f"{out_dir}/models/{run}", family, params, features, labels)
            metrics = {"best_cv_f1_macro": best["mean_test_f1_macro"]}
            for split in ("validation", "test"):
                scored = TR.score_models(data.where(F.col("split") == split), [model], ["label"])
                report = G.evaluate_split(scored, "label", "prediction", "proba", labels)
                report = report.select(F.lit(run).alias("run_id"), F.lit(split).alias("split"), *report.columns)
                report.write.mode("overwrite").parquet(f"{out_dir}/reports/{run}-{split}")
                own = spark.read.schema(REPORT_ROWS).parquet(f"{out_dir}/reports/{run}-{split}").where("section = 'metrics'")
                metrics.update({f"{split}_{r['key']}": r["value"] for r in own.collect()})  # eight rows
            facts = {"model_name": family, "grid_size": grid, "cv": folds, "random_state": seed,
                     **{f"best_{k}": v for k, v in params.items()}, "best_params": json.dumps(params, sort_keys=True)}
            p_rows, m_rows = R.log_run(run, facts, {k: v for k, v in metrics.items() if v is not None}, spark)
            p_rows.coalesce(1).write.mode("append").parquet(f"{out_dir}/run_params")
            m_rows.coalesce(1).write.mode("append").parquet(f"{out_dir}/run_metrics")  # last: the run is whole
    finally:
        train.unpersist()
    return select_and_register(spark, out_dir, families, created_at, name, alias, lambda f: run_id_of(name, f, grid, folds, seed))


COMPARED = ["best_cv_f1_macro", *[f"{s}_{m}" for s in ("validation", "test") for m in TR.CV_METRICS]]


def select_and_register(spark: SparkSession, out_dir: str, families, created_at, name: str, alias: str, run_of) -> DataFrame:
    """The comparison of the runs in ``out_dir``, the champion and its version and alias."""
    runs = spark.createDataFrame([(run_of(f), f, i) for i, f in enumerate(families)], "run_id string, model_name string, position int")
    metrics = A.read_if_written(spark, f"{out_dir}/run_metrics", RUN_METRICS).dropDuplicates(["run_id", "metric"])
    params = A.read_if_written(spark, f"{out_dir}/run_params", RUN_PARAMS).where("param = 'best_params'").dropDuplicates(["run_id"])
    table = materialize(R.model_comparison(metrics, COMPARED, runs).join(params.select("run_id", F.col("value").alias("best_params")), "run_id"))
    table.orderBy(F.desc("validation_f1_macro"), "position").write.mode("overwrite").parquet(f"{out_dir}/comparison")
    champion = R.select_champion(table.withColumn("name", F.lit(name)), "name", "validation_f1_macro", "position").first()
    versions = A.read_if_written(spark, f"{out_dir}/model_versions", "name string, version long, run_id string, created_at timestamp_ntz")
    own = versions.where((F.col("name") == name) & (F.col("run_id") == champion["run_id"]))
    if not own.take(1):
        R.register_version(versions, name, champion["run_id"], created_at).coalesce(1).write.mode("append").parquet(f"{out_dir}/model_versions")
        versions = spark.read.schema(versions.schema).parquet(f"{out_dir}/model_versions")
        own = versions.where((F.col("name") == name) & (F.col("run_id") == champion["run_id"]))
    aliases = A.read_if_written(spark, f"{out_dir}/model_aliases", "name string, alias string, version long, set_at timestamp_ntz")
    now = R.resolve_model(versions, aliases, alias).where((F.col("name") == name) & (F.col("source") == "alias"))
    if not now.join(own, ["name", "version"], "left_semi").take(1):
        R.set_alias(own, alias, created_at).coalesce(1).write.mode("append").parquet(f"{out_dir}/model_aliases")
        aliases = spark.read.schema(aliases.schema).parquet(f"{out_dir}/model_aliases")
        now = R.resolve_model(versions, aliases, alias).where((F.col("name") == name) & (F.col("source") == "alias"))
    summary = TR.training_summary(champion["model_name"], champion["validation_f1_macro"], champion["run_id"], f"{out_dir}/models/{champion['run_id']}")
    A.write_report(spark.createDataFrame([tuple(summary.values())], "best_model_name string, best_validation_f1_macro double, "
                                                                    "best_run_id string, model_path string"), f"{out_dir}/training_summary")
    held = now.join(versions, ["name", "version"]).select("run_id", "version", F.lit(alias).alias("alias"))
    return table.join(held, "run_id", "left").select("model_name", *COMPARED, "best_params", "run_id", "version", "alias")
