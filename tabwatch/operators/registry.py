"""Model registry as tables.

Tables: model_versions(name, version, run_id, created_at), model_aliases(name, alias,
version, set_at) as an append-only history, run_metrics(run_id, metric, value),
run_params(run_id, param, value). Every read is an aggregation or a join; the current
alias is the latest history row (max_by), so appends never rewrite data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.operators.prefix import positions, running_totals


def rank_candidates(results: DataFrame, score: str, rank_col: str = "rank", **kw) -> DataFrame:
    """Rank by descending score, ties share the minimum rank (``rank()``), without a global window.

    rank = 1 + number of rows with a strictly greater score, from bucketed prefix sums over the
    distinct scores.
    """
    counts = results.groupBy(score).agg(F.count(F.lit(1)).alias("_c"))
    rt = running_totals(counts, [], score, ["_c"], descending=True, **kw)
    ranks = rt.select(score, (F.col("cum__c") - F.col("_c") + 1).alias(rank_col))
    return results.join(ranks, score, "left")


def model_comparison(run_metrics: DataFrame, metrics, runs: DataFrame | None = None, run: str = "run_id") -> DataFrame:
    """One row per run with a column per metric (pivot on a fixed metric list: no extra job)."""
    wide = run_metrics.groupBy(run).pivot("metric", list(metrics)).agg(F.first("value"))
    return wide if runs is None else runs.join(wide, run, "left")


def select_champion(candidates: DataFrame, group: str, score: str, position: str) -> DataFrame:
    """Per group, highest score wins; on ties the earlier position wins (strictly greater)."""
    best = F.max_by(F.struct(*[F.col(c) for c in candidates.columns]),
                    F.struct(F.col(score), -F.col(position)))
    return candidates.groupBy(group).agg(best.alias("_b")).select("_b.*")


def log_run(run_id: str, params: dict, metrics: dict, spark, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """Long rows for run_params / run_metrics (append them to the tables)."""
    p = spark.createDataFrame([(run_id, k, str(v)) for k, v in params.items()], "run_id string, param string, value string")
    m = spark.createDataFrame([(run_id, prefix + k, float(v)) for k, v in metrics.items()],
                              "run_id string, metric string, value double")
    return p, m


def current_aliases(aliases: DataFrame) -> DataFrame:
    """The current version of each (name, alias): the latest history row."""
    return aliases.groupBy("name", "alias").agg(F.max_by("version", F.struct("set_at", "version")).alias("version"),
                                                F.max("set_at").alias("set_at"))


def register_version(versions: DataFrame, name: str, run_id: str, created_at) -> DataFrame:
    """The next version row for ``name`` (to append): max(version) + 1."""
    nxt = versions.where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0)) + 1)
    return nxt.select(F.lit(name).alias("name"), F.col(nxt.columns[0]).cast("long").alias("version"),
                      F.lit(run_id).alias("run_id"), F.lit(created_at).cast("timestamp_ntz").alias("created_at"))


def set_alias(new_versions: DataFrame, alias: str = "champion", set_at=None) -> DataFrame:
    """Alias history rows pointing ``alias`` at the given (name, version) rows (append them;
    the current alias is the latest history row, so moving an alias never rewrites data)."""
    at = F.lit(set_at).cast("timestamp_ntz") if set_at is not None else F.col("created_at")
    return new_versions.select("name", F.lit(alias).alias("alias"), "version", at.alias("set_at"))


def resolve_model(versions: DataFrame, aliases: DataFrame, alias: str = "champion") -> DataFrame:
    """Alias -> version, else highest integer version: (name, version, source)."""
    cur = current_aliases(aliases.where(F.col("alias") == alias)).select("name", F.col("version").alias("_av"))
    latest = versions.groupBy("name").agg(F.max(F.col("version").cast("long")).alias("_mv"))
    j = latest.join(cur, "name", "left")
    return j.select("name", F.coalesce("_av", "_mv").alias("version"),
                    F.when(F.col("_av").isNotNull(), F.lit("alias")).otherwise(F.lit("latest")).alias("source"))


def list_models(versions: DataFrame, as_lists: bool = False, **kw) -> DataFrame:
    """Versions per model as strings, by integer version descending (long form with position).

    The position comes from bucketed prefix sums, so a model with very many versions is not
    ranked by one task; ``as_lists`` adds the collected list form for display.
    """
    v = versions.select("name", F.col("version").cast("long").alias("version")).distinct()
    pos = positions(v, ["name"], "version", descending=True, name="position", **kw)
    out = pos.select("name", F.col("version").cast("string").alias("version"), "position")
    if as_lists:
        return out.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "version"))),
                                                   lambda s: s["version"]).alias("versions"))
    return out


def champion_metrics(resolved: DataFrame, versions: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """Metrics of the resolved version (long form; empty when none)."""
    runs = resolved.join(versions.select("name", "version", "run_id"), ["name", "version"], "inner")
    return runs.join(run_metrics, "run_id", "inner").select("name", "version", "metric", "value")


def promotion_gate(versions: DataFrame, aliases: DataFrame, run_metrics: DataFrame, metric: str,
                   tolerance: float = 0.0, alias: str = "champion") -> DataFrame:
    """Promote the newest version when its metric is no worse than the champion's - tolerance."""
    latest = versions.groupBy("name").agg(F.max("version").alias("candidate_version"))
    champ = resolve_model(versions, aliases, alias).where(F.col("source") == "alias").select(
        "name", F.col("version").alias("champion_version"))
    m = run_metrics.where(F.col("metric") == metric).select("run_id", "value")
    vm = versions.select("name", "version", "run_id").join(m, "run_id", "left")
    cand = latest.join(vm.select("name", F.col("version").alias("candidate_version"),
                                 F.col("value").alias("candidate_metric")), ["name", "candidate_version"], "left")
    ch = champ.join(vm.select("name", F.col("version").alias("champion_version"),
                              F.col("value").alias("champion_metric")), ["name", "champion_version"], "left")
    j = cand.join(ch, "name", "left")
    ok = F.col("champion_version").isNull() | (F.col("candidate_metric") >= F.col("champion_metric") - tolerance)
    return j.select("name", "candidate_version", "champion_version", "candidate_metric", "champion_metric",
                    F.coalesce(ok, F.lit(False)).alias("promote"))
