"""Bindings for projection / filter / schema operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwatch.operators import clean as B
from tabwatch.operators.score import deterministic_id
from tabwatch.plans.catalog import LI_FEATURES, LI_KEY, LI_SQL, lineitem_frame, r6, register, table
from tabwatch.spec import DEFAULT_LABEL_RULES, NUMERIC_PATTERN, UUID_PATTERN

_NUM_SQL = ("CASE WHEN regexp_matches(CAST({x} AS VARCHAR), '" + NUMERIC_PATTERN
            + "') THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END")


def _num_sql(x: str) -> str:
    inner = _NUM_SQL.format(x=x)
    return f"(CASE WHEN abs({inner}) < 'inf'::DOUBLE THEN {inner} END)"


@register("rename_columns", """
SELECT l_orderkey AS order_key, l_quantity AS quantity, l_extendedprice AS price, l_discount, l_tax FROM lineitem""")
def q_rename_columns(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return B.rename_columns(li, {"l_orderkey": "order_key", "l_quantity": "quantity", "l_extendedprice": "price",
                                 "not_there": "ignored"})


@register("coerce_numeric", f"""
SELECT o_orderkey, {_num_sql("split_part(o_orderpriority, '-', 1)")} AS priority,
       {_num_sql('o_orderpriority')} AS priority_text, {_num_sql('o_totalprice')} AS totalprice,
       CAST(CASE WHEN {_num_sql('o_totalprice')} = floor({_num_sql('o_totalprice')})
                 THEN {_num_sql('o_totalprice')} END AS INTEGER) AS price_class
FROM orders""")
def q_coerce_numeric(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(1)).alias("priority"),
        F.col("o_orderpriority").alias("priority_text"), F.col("o_totalprice").cast("string").alias("totalprice"),
        F.col("o_totalprice").cast("string").alias("price_class"))
    return B.coerce_numeric(o, ["priority", "priority_text", "totalprice"], target="price_class")


_BUCKET_SQL = """(SELECT p_partkey, p_size / 5.0 AS score,
  CASE WHEN p_size / 5.0 <= 5 THEN 'low' WHEN p_size / 5.0 = 6 THEN 'medium' WHEN p_size / 5.0 >= 7 THEN 'high' END AS quality_label
FROM part)"""


def _bucketed(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 5.0).alias("score"))
    return B.bucket_label(p, "score", DEFAULT_LABEL_RULES)


@register("bucket_label", f"""
SELECT *, CAST(CASE quality_label WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS INTEGER) AS quality_class
FROM {_BUCKET_SQL}""")
def q_bucket_label(spark, sf):
    return _bucketed(spark, sf)


@register("drop_invalid_targets", f"""
SELECT *, CAST(CASE quality_label WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS INTEGER) AS quality_class
FROM {_BUCKET_SQL} WHERE quality_label IS NOT NULL""")
def q_drop_invalid_targets(spark, sf):
    return B.drop_invalid_targets(_bucketed(spark, sf), ["quality_label", "quality_class"])


_DUP = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


@register("drop_exact_duplicates", f"SELECT DISTINCT {', '.join(_DUP)} FROM lineitem")
def q_drop_exact_duplicates(spark, sf):
    return B.drop_exact_duplicates(table(spark, sf, "lineitem").select(*_DUP))


@register("duplicate_summary", f"""
SELECT CAST(sum(c) AS BIGINT) AS rows_before, count(*) AS rows_after, CAST(sum(c - 1) AS BIGINT) AS removed
FROM (SELECT count(*) AS c FROM lineitem GROUP BY {', '.join(_DUP)})""")
def q_duplicate_summary(spark, sf):
    return B.duplicate_summary(table(spark, sf, "lineitem").select(*_DUP))


@register("select_features_target", f"SELECT {', '.join(LI_FEATURES)}, l_returnflag FROM {LI_SQL}")
def q_select_features_target(spark, sf):
    return B.select_features_target(lineitem_frame(spark, sf), LI_FEATURES, "l_returnflag")


@register("expand_json_features", """
SELECT event_id, je.key AS feature, CAST(je.value AS DOUBLE) AS value FROM events, json_each(props) je""")
def q_expand_json_features(spark, sf):
    return B.expand_json_features(table(spark, sf, "events"), "props", ids=["event_id"])


@register("encode_json", """
SELECT event_id, CAST(to_json({'value': value, 'user_id': user_id}) AS VARCHAR) AS payload FROM events""")
def q_encode_json(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.struct("value", "user_id").alias("_s"))
    return B.encode_json(ev, {"payload": "_s"}).select("event_id", "payload")


def _ramp_sql():
    x = "least(l_extendedprice / 110000.0, 1.0)"
    s = [f"(1.0 - {x})", f"(1.0 - abs(2.0 * {x} - 1.0))", f"{x}"]
    tot = " + ".join(s)
    return [f"round(({v}) / ({tot}), 6)" for v in s]


def ramps(df):
    """Normalised price ramps: a probability-like score per class (low, medium, high)."""
    x = F.least(F.col("l_extendedprice") / 110000.0, F.lit(1.0))
    s = [1.0 - x, 1.0 - F.abs(2.0 * x - 1.0), x]
    tot = s[0] + s[1] + s[2]
    return df.withColumn("scores", F.array(*[r6(v / tot) for v in s]))


@register("decode_class", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_linenumber % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS predicted_label,
  CASE l_linenumber % 4 WHEN 0 THEN {_ramp_sql()[0]} WHEN 1 THEN {_ramp_sql()[1]} WHEN 2 THEN {_ramp_sql()[2]} END
    AS label_probability
FROM lineitem""")
def q_decode_class(spark, sf):
    li = ramps(table(spark, sf, "lineitem")).withColumn("cls", F.col("l_linenumber") % 4)
    out = B.decode_class(li, "cls", proba_col="scores")
    return out.select(*LI_KEY, "predicted_label",
                      F.try_element_at("probabilities", F.col("predicted_label")).alias("label_probability"))


def _scoring_err_sql():
    parts = []
    for c in LI_FEATURES:
        parts.append(f"CASE WHEN {c} IS NULL THEN '{c}: field required' END")
        parts.append(f"CASE WHEN {c} IS NOT NULL AND (isnan({c}) OR abs({c}) = 'inf'::DOUBLE) "
                     f"THEN '{c}: must be a finite number' END")
        if c == "l_discount":
            parts.append(f"CASE WHEN {c} < 0.0 OR {c} > 0.08 THEN '{c}: must be between 0.0 and 0.08' END")
    return "concat_ws(',', " + ", ".join(parts) + ")"


@register("validate_scoring_rows", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_scoring_err_sql()} AS errors,
       {_scoring_err_sql()} = '' AS valid FROM {LI_SQL}""")
def q_validate_scoring_rows(spark, sf):
    v = B.validate_scoring_rows(lineitem_frame(spark, sf), LI_FEATURES, {"l_discount": (0.0, 0.08)})
    return v.select(*LI_KEY, F.array_join("errors", ",").alias("errors"), (F.size("errors") == 0).alias("valid"))


def _uuid_sql(h: str) -> str:
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
            f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")


_FB_SQL = f"""(SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN {_uuid_sql("md5(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR))")}
       ELSE md5(CAST(conv_id AS VARCHAR)) END AS prediction_id,
  turn - 2 AS actual_class, text AS comment FROM conversations)"""


@register("validate_feedback_rows", f"""
SELECT conv_id, turn, concat_ws(',',
  CASE WHEN prediction_id IS NULL OR NOT regexp_matches(prediction_id, '{UUID_PATTERN}') THEN 'prediction_id: invalid uuid' END,
  CASE WHEN actual_class IS NULL THEN 'actual_class: field required' END,
  CASE WHEN actual_class < 0 THEN 'actual_class: must be >= 0' END,
  CASE WHEN length(comment) > 500 THEN 'comment: at most 500 characters' END) AS errors
FROM {_FB_SQL}""")
def q_validate_feedback_rows(spark, sf):
    c = table(spark, sf, "conversations")
    fb = c.select("conv_id", "turn",
                  F.when(F.col("role") == "user", deterministic_id("conv_id", "turn"))
                  .otherwise(F.md5(F.col("conv_id").cast("string"))).alias("prediction_id"),
                  (F.col("turn") - 2).alias("actual_class"), F.col("text").alias("comment"))
    v = B.validate_feedback_rows(fb)
    return v.select("conv_id", "turn", F.array_join("errors", ",").alias("errors"))


@register("head_rows", """
SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10""")
def q_head_rows(spark, sf):
    return B.head_rows(table(spark, sf, "lineitem"), 10, LI_KEY)

