"""Bindings for the registry operators (E9-E11, E13-E18), tables derived from part.

model = p_brand, version = p_partkey, run_id = 'run-' || p_partkey,
created_at = 2024-01-01 + p_partkey minutes; run metrics: validation_f1_macro = p_size / 50,
test_f1_macro = p_retailprice / 2000; champion alias history: PROMO parts of size >= 48,
set one hour after creation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import registry as R
from tabwatch.plans.catalog import r6, register, table


def _base():
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")


def versions(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"),
                    F.concat(F.lit("run-"), F.col("p_partkey").cast("string")).alias("run_id"),
                    (_base() + F.make_dt_interval(F.lit(0), F.lit(0), F.col("p_partkey").cast("int"))).alias("created_at"))


def run_metrics(spark, sf):
    p = table(spark, sf, "part")
    run = F.concat(F.lit("run-"), F.col("p_partkey").cast("string"))
    return p.select(run.alias("run_id"), F.inline(F.array(
        F.struct(F.lit("validation_f1_macro").alias("metric"), (F.col("p_size") / 50.0).alias("value")),
        F.struct(F.lit("test_f1_macro").alias("metric"), (F.col("p_retailprice") / 2000.0).alias("value")))))


def aliases(spark, sf):
    p = table(spark, sf, "part").where((F.col("p_type") == "PROMO") & (F.col("p_size") >= 48))
    return p.select(F.col("p_brand").alias("name"), F.lit("champion").alias("alias"), F.col("p_partkey").alias("version"),
                    (_base() + F.make_dt_interval(F.lit(0), F.lit(1), F.col("p_partkey").cast("int"))).alias("set_at"))


VERSIONS_SQL = ("(SELECT p_brand AS name, p_partkey AS version, 'run-' || CAST(p_partkey AS VARCHAR) AS run_id, "
                "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p_partkey AS BIGINT)) AS created_at FROM part)")
METRICS_SQL = ("(SELECT 'run-' || CAST(p_partkey AS VARCHAR) AS run_id, 'validation_f1_macro' AS metric, p_size / 50.0 AS value FROM part "
               "UNION ALL SELECT 'run-' || CAST(p_partkey AS VARCHAR), 'test_f1_macro', p_retailprice / 2000.0 FROM part)")
ALIASES_SQL = ("(SELECT p_brand AS name, 'champion' AS alias, p_partkey AS version, "
               "TIMESTAMP '2024-01-01 01:00:00' + to_minutes(CAST(p_partkey AS BIGINT)) AS set_at FROM part "
               "WHERE p_type = 'PROMO' AND p_size >= 48)")
RESOLVED_SQL = f"""(SELECT v.name, coalesce(a.version, v.mv) AS version,
  CASE WHEN a.version IS NOT NULL THEN 'alias' ELSE 'latest' END AS source
  FROM (SELECT name, max(version) AS mv FROM {VERSIONS_SQL} GROUP BY name) v
  LEFT JOIN (SELECT name, arg_max(version, (set_at, version)) AS version FROM {ALIASES_SQL} GROUP BY name) a USING (name))"""


@register("rank_candidates", f"""
SELECT run_id, metric, round(value, 6) AS value, rank() OVER (ORDER BY value DESC) AS rank
FROM {METRICS_SQL} WHERE metric = 'validation_f1_macro'""")
def q_rank_candidates(spark, sf):
    m = run_metrics(spark, sf).where(F.col("metric") == "validation_f1_macro")
    r = R.rank_candidates(m, "value")
    return r.select("run_id", "metric", r6("value").alias("value"), F.col("rank").cast("long").alias("rank"))


@register("model_comparison", f"""
SELECT v.name, v.version, v.run_id,
  round(max(value) FILTER (WHERE metric = 'validation_f1_macro'), 6) AS validation_f1_macro,
  round(max(value) FILTER (WHERE metric = 'test_f1_macro'), 6) AS test_f1_macro
FROM {VERSIONS_SQL} v LEFT JOIN {METRICS_SQL} m USING (run_id) GROUP BY v.name, v.version, v.run_id""")
def q_model_comparison(spark, sf):
    c = R.model_comparison(run_metrics(spark, sf), ["validation_f1_macro", "test_f1_macro"],
                           versions(spark, sf).select("name", "version", "run_id"))
    return c.select("name", "version", "run_id", r6("validation_f1_macro").alias("validation_f1_macro"),
                    r6("test_f1_macro").alias("test_f1_macro")).orderBy(F.desc("validation_f1_macro"), "version")


_CAND_SQL = f"""(SELECT v.name, v.version, m.value AS f1 FROM {VERSIONS_SQL} v JOIN {METRICS_SQL} m USING (run_id)
  WHERE metric = 'validation_f1_macro')"""


@register("select_champion", f"""
SELECT name, version, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f1 DESC, version ASC)
AS rn FROM {_CAND_SQL}) WHERE rn = 1""")
def q_select_champion(spark, sf):
    m = run_metrics(spark, sf).where(F.col("metric") == "validation_f1_macro")
    cand = versions(spark, sf).join(m, "run_id").select("name", "version", F.col("value").alias("f1"))
    ch = R.select_champion(cand, "name", "f1", "version")
    return ch.select("name", "version", r6("f1").alias("f1"))


@register("current_alias", f"""
SELECT name, alias, arg_max(version, (set_at, version)) AS version, max(set_at) AS set_at FROM {ALIASES_SQL} GROUP BY ALL""")
def q_current_alias(spark, sf):
    return R.current_aliases(aliases(spark, sf))


@register("resolve_model", f"SELECT * FROM {RESOLVED_SQL}")
def q_resolve_model(spark, sf):
    return R.resolve_model(versions(spark, sf), aliases(spark, sf))


@register("list_models", f"""
SELECT name, CAST(version AS VARCHAR) AS version, row_number() OVER (PARTITION BY name ORDER BY version DESC) AS position
FROM {VERSIONS_SQL}""")
def q_list_models(spark, sf):
    return R.list_models(versions(spark, sf))


@register("champion_metrics", f"""
SELECT r.name, r.version, m.metric, round(m.value, 6) AS value FROM {RESOLVED_SQL} r
JOIN {VERSIONS_SQL} v ON v.name = r.name AND v.version = r.version JOIN {METRICS_SQL} m ON m.run_id = v.run_id""")
def q_champion_metrics(spark, sf):
    res = R.resolve_model(versions(spark, sf), aliases(spark, sf))
    cm = R.champion_metrics(res, versions(spark, sf), run_metrics(spark, sf))
    return cm.select("name", "version", "metric", r6("value").alias("value"))


@register("promotion_gate", f"""
WITH vm AS (SELECT v.name, v.version, m.value FROM {VERSIONS_SQL} v LEFT JOIN
            (SELECT * FROM {METRICS_SQL} WHERE metric = 'validation_f1_macro') m USING (run_id)),
cand AS (SELECT name, max(version) AS candidate_version FROM {VERSIONS_SQL} GROUP BY name),
ch AS (SELECT name, version AS champion_version FROM {RESOLVED_SQL} WHERE source = 'alias')
SELECT c.name, c.candidate_version, ch.champion_version, round(a.value, 6) AS candidate_metric,
  round(b.value, 6) AS champion_metric,
  coalesce(ch.champion_version IS NULL OR a.value >= b.value - 0.01, false) AS promote
FROM cand c LEFT JOIN vm a ON a.name = c.name AND a.version = c.candidate_version
LEFT JOIN ch ON ch.name = c.name LEFT JOIN vm b ON b.name = c.name AND b.version = ch.champion_version""")
def q_promotion_gate(spark, sf):
    g = R.promotion_gate(versions(spark, sf), aliases(spark, sf), run_metrics(spark, sf), "validation_f1_macro", 0.01)
    return g.select("name", "candidate_version", "champion_version", r6("candidate_metric").alias("candidate_metric"),
                    r6("champion_metric").alias("champion_metric"), "promote")
