"""Projections, filters and schema operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwatch.functions.columns import first_match, to_integral, to_number
from tabwatch.spec import CLASS_LABELS, DEFAULT_LABEL_RULES, TARGET_NAMES, UUID_PATTERN


def validate_columns(df: DataFrame, required) -> DataFrame:
    """B1: raise ValueError listing every required column that is missing (no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """B2: rename mapped columns; unmapped and absent keys are left alone."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def snake_case_mapping(columns) -> dict:
    """``"fixed acidity" -> "fixed_acidity"``, ``"pH" -> "ph"``."""
    return {c: c.strip().lower().replace(" ", "_") for c in columns}


def coerce_numeric(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """Lenient text -> double for features; target -> nullable int (fractional -> NULL)."""
    exprs = {c: to_number(c) for c in features}
    if target is not None:
        exprs[target] = to_integral(to_number(target))
    return df.withColumns(exprs)


def bucket_label(df: DataFrame, source: str, rules=DEFAULT_LABEL_RULES, label_col: str = "quality_label",
                 class_col: str = "quality_class", classes: dict | None = None) -> DataFrame:
    """First-match-wins bucketing of ``source`` into a label, then label -> class id."""
    classes = classes if classes is not None else {v: k for k, v in CLASS_LABELS.items()}
    lookup = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    label = first_match(rules, source)
    return df.withColumn(label_col, label).withColumn(
        class_col, F.try_element_at(lookup, F.col(label_col)).cast("int"))


def drop_invalid_targets(df: DataFrame, cols) -> DataFrame:
    """Drop rows where any target column is NULL; integral target columns become int."""
    return df.dropna(subset=list(cols))


def drop_exact_duplicates(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Exact duplicates over all columns (NULLs equal); keeps one row per group, with the size of
    the group in the column ``copies`` if one is named."""
    return df.dropDuplicates() if copies is None else df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """B6 / D6 counts from one grouping: rows_before, rows_after, removed."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_cnt"))
    return g.agg(F.sum("_cnt").cast("long").alias("rows_before"),
                 F.count(F.lit(1)).cast("long").alias("rows_after"),
                 F.sum(F.col("_cnt") - 1).cast("long").alias("removed"))


def select_features_target(df: DataFrame, features, target: str | None = None) -> DataFrame:
    """B7."""
    return df.select(*features, *([target] if target else []))


def expand_json_features(df: DataFrame, json_col: str, ids=(), name: str = "feature",
                         value: str = "value") -> DataFrame:
    """JSON object text -> long form (ids..., feature, value double). No wide step.

    Keys whose value is no number (text, objects, true / false) are left out, the others stay;
    a null value is a NULL.
    """
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.StringType()))
    rows = df.select(*ids, F.explode(m).alias(name, "_text"))
    number = to_number("_text")
    return rows.where(F.col("_text").isNull() | number.isNotNull()).select(*ids, name, number.alias(value))


def encode_json(df: DataFrame, cols: dict) -> DataFrame:
    """Struct / map columns -> JSON text; NULL stays NULL. cols = {out: in}."""
    return df.withColumns({out: F.to_json(F.col(src)) for out, src in cols.items()})


def decode_class(df: DataFrame, class_col: str, out: str = "predicted_label", labels: dict | None = None,
                 proba_col: str | None = None, proba_out: str = "probabilities") -> DataFrame:
    """Class id -> label (unknown -> "unknown"); probability array -> {label: p} map."""
    labels = labels if labels is not None else CLASS_LABELS
    lookup = F.create_map(*[x for k, v in sorted(labels.items()) for x in (F.lit(k), F.lit(v))])
    res = df.withColumn(out, F.coalesce(F.try_element_at(lookup, F.col(class_col).cast("int")),
                                        F.lit("unknown")))
    if proba_col is not None:
        names = F.array(*[F.lit(v) for _, v in sorted(labels.items())])
        res = res.withColumn(proba_out, F.map_from_arrays(names, F.col(proba_col)))
    return res


def scoring_errors(features, ranges: dict | None = None) -> F.Column:
    """B13 error list: each feature required and finite; optional [lo, hi] ranges."""
    ranges = ranges or {}
    checks = []
    for c in features:
        x = F.col(c)
        checks.append(F.when(x.isNull(), F.lit(f"{c}: field required")))
        checks.append(F.when(x.isNotNull() & (F.isnan(x) | (F.abs(x) == float("inf"))),
                             F.lit(f"{c}: must be a finite number")))
        if c in ranges:
            lo, hi = ranges[c]
            checks.append(F.when((x < lo) | (x > hi), F.lit(f"{c}: must be between {lo} and {hi}")))
    return F.array_compact(F.array(*checks))


def validate_scoring_rows(df: DataFrame, features, ranges: dict | None = None,
                          errors: str = "errors") -> DataFrame:
    """Add ``errors: array<string>``; valid rows have an empty array."""
    return df.withColumn(errors, scoring_errors(features, ranges))


def validate_feedback_rows(df: DataFrame, id_col: str = "prediction_id", class_col: str = "actual_class",
                           comment_col: str = "comment", errors: str = "errors",
                           max_comment: int = 500) -> DataFrame:
    """UUID id, class >= 0, comment at most 500 characters (NULL allowed)."""
    checks = F.array(
        F.when(F.col(id_col).isNull() | ~F.col(id_col).rlike(UUID_PATTERN),
               F.lit(f"{id_col}: invalid uuid")),
        F.when(F.col(class_col).isNull(), F.lit(f"{class_col}: field required")),
        F.when(F.col(class_col) < 0, F.lit(f"{class_col}: must be >= 0")),
        F.when(F.char_length(F.col(comment_col)) > max_comment,
               F.lit(f"{comment_col}: at most {max_comment} characters")),
    )
    return df.withColumn(errors, F.array_compact(checks))


def split_valid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(valid rows without the errors column, rejected rows with it)."""
    ok = F.size(F.col(errors)) == 0
    return df.where(ok).drop(errors), df.where(~ok)


def head_rows(df: DataFrame, n: int, order) -> DataFrame:
    """First n rows by an explicit key (Spark has no row order). TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns from the schema (no job), minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def common_numeric_features(ref: DataFrame, cur: DataFrame, exclude=TARGET_NAMES) -> list[str]:
    """numeric(ref) & numeric(cur) - targets, sorted; empty -> ValueError."""
    common = sorted(set(numeric_columns(ref, exclude)) & set(numeric_columns(cur, exclude)))
    if not common:
        raise ValueError("no common numeric feature")
    return common


def find_target_column(df: DataFrame, candidates) -> str:
    """K8: first known target name present."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no target column among {list(candidates)}")


def duplicate_rows(df: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """Every row beyond the first of its identical group (NULLs equal), as rows.

    One grouping, then each group's surplus copies are emitted in chunks that are spread
    over tasks, so a hot group is not expanded by one task.
    """
    cols = df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col("_cnt") > 1)
    g = g.withColumn("_extra", F.col("_cnt") - 1)
    parts = g.select(*cols, "_extra", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_extra") - 1) / chunk).cast("long"))).alias("_chunk"))
    parts = parts.repartition(*cols, "_chunk")
    return parts.select(*cols, F.explode(F.sequence(
        F.lit(1).cast("long"),
        F.least(F.lit(chunk).cast("long"), F.col("_extra") - F.col("_chunk") * chunk))).alias("_i")
    ).drop("_i")

