"""Scoring and feedback (H1, H3, H4).

Feedback is attached at READ time: latest feedback per prediction id (last write wins,
order-free, so feedback that lands before its prediction still attaches) left-joined onto
the prediction events. Both sides shuffle on the id; a hot id is pre-aggregated map-side.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.operators.clean import decode_class


def deterministic_id(*cols) -> F.Column:
    """UUID-formatted md5 of the request key: retries give the same id (unlike uuid())."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def python_deterministic_id(*parts) -> str:
    """Same id computed in Python (for tests)."""
    h = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def latest_feedback_per_id(feedback: DataFrame, id_col: str = "prediction_id", at: str = "feedback_at",
                           tie=(), values=("actual_class", "comment")) -> DataFrame:
    """Last write wins per id, ordered by (feedback time, tie...); one row per id."""
    order = F.struct(F.col(at), *[F.col(t) for t in tie])
    cols = [c for c in values if c in feedback.columns] + [at]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), order)
    return feedback.groupBy(id_col).agg(best.alias("_fb")).select(id_col, *[F.col(f"_fb.{c}").alias(c)
                                                                            for c in cols])


def attach_feedback(predictions: DataFrame, feedback: DataFrame, id_col: str = "prediction_id",
                    predicted: str = "predicted_class", actual: str = "actual_class",
                    at: str = "feedback_at", tie=(), comment: str = "comment") -> DataFrame:
    """H3: predictions + actual_class, feedback_at, feedback_comment, is_correct (text compare)."""
    latest = latest_feedback_per_id(feedback, id_col, at, tie, (actual, comment))
    if comment in latest.columns:
        latest = latest.withColumnRenamed(comment, "feedback_comment")
    pred = predictions.drop(*[c for c in (actual, at, "feedback_comment", "is_correct") if c in predictions.columns])
    j = pred.join(latest, id_col, "left")
    return j.withColumn("is_correct", F.when(F.col(actual).isNotNull(),
                                             F.col(predicted).cast("string") == F.col(actual).cast("string")))


def unmatched_feedback(predictions: DataFrame, feedback: DataFrame, id_col: str = "prediction_id") -> DataFrame:
    """H4: feedback rows whose id has no prediction (the 404 case), as a reject table."""
    return feedback.join(predictions.select(id_col), id_col, "left_anti")


def score_batch(df: DataFrame, model, params=None, features=None, model_name: str = "model",
                model_version: str | None = None, model_alias: str | None = None, keep=(),
                labels: dict | None = None) -> DataFrame:
    """H1: apply fitted preparation (C9), then the Spark ML model, then decode.

    ``model`` is a fitted Spark ML model/PipelineModel reading a ``features`` vector column.
    """
    from pyspark.ml.feature import VectorAssembler

    from tabwatch.operators.prepare import apply_preparation
    from tabwatch.operators.train import predict_with_proba

    feats = list(features)
    prepared = apply_preparation(df, params, feats, keep=list(keep)) if params is not None else df
    vec = VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep").transform(prepared)
    out = decode_class(predict_with_proba(model, vec), "prediction", out="predicted_label", labels=labels, proba_col="proba")
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted_class"), "predicted_label",
                      "probabilities", F.lit(model_name).alias("model_name"),
                      F.lit(model_version).cast("string").alias("model_version"),
                      F.lit(model_alias).cast("string").alias("model_alias"))
