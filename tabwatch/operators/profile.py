"""Profiling aggregations.

Wide statistics are computed in ONE aggregate pass over all columns and only the single
result row is unpivoted. Quantiles are bracketed (:mod:`quantiles`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.functions.columns import as_number, case_lookup, missing, safe_div
from tabwatch.functions.reshape import to_long
from tabwatch.operators.clean import duplicate_rows  # noqa: F401  (D7 lives with B6)
from tabwatch.operators.quantiles import column_quantiles


def _inline(row: DataFrame, key_name: str, items) -> DataFrame:
    """items: list of (key literal, {out_col: Column}) -> long rows from a one-row frame."""
    structs = [F.struct(F.lit(k).alias(key_name), *[c.alias(n) for n, c in cols.items()])
               for k, cols in items]
    return row.select(F.inline(F.array(*structs)))


def numbers(df: DataFrame, features) -> DataFrame:
    """The features as double, NaN as NULL: guarded once, below the aggregates that read them."""
    return df.select(*[as_number(c).alias(c) for c in features])


def profile_shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def profile_schema(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null)."""
    row = df.agg(*[F.count_if(~missing(df, c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)])
    return _inline(row, "column", [(f.name, {"dtype": F.lit(f.dataType.simpleString()),
                                             "non_null": F.col(f"_nn{i}")})
                                   for i, f in enumerate(df.schema.fields)])


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """D4 + D5: (column, null_count, null_percent)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(missing(df, c)).alias(f"_z{i}") for i, c in enumerate(cols)])
    return _inline(row, "column", [(c, {"null_count": F.col(f"_z{i}"),
                                        "null_percent": F.coalesce(safe_div(F.col(f"_z{i}") * 100.0,
                                                                            F.col("_n")), F.lit(0.0))})
                                   for i, c in enumerate(cols)])


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_cnt"))
    return g.agg(F.coalesce(F.sum(F.col("_cnt") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def value_counts_by_key(df: DataFrame, col: str) -> DataFrame:
    """(value, count) ordered by value (NULL kept as its own group)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(col)


def value_counts_by_freq(df: DataFrame, col: str) -> DataFrame:
    """(value, count) by descending frequency, NULL dropped, ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(col)))


def describe_numeric(df: DataFrame, features) -> DataFrame:
    """D3: per feature count, mean, std (sample), min, q25, q50, q75, max."""
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c)
        aggs += [F.count(x).alias(f"_c{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                 F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    stats = _inline(numbers(df, features).agg(*aggs), "feature", [
        (c, {"count": F.col(f"_c{i}"), "mean": F.col(f"_m{i}"), "std": F.col(f"_s{i}"),
             "min": F.col(f"_lo{i}"), "max": F.col(f"_hi{i}")}) for i, c in enumerate(features)])
    q = df.sparkSession.createDataFrame(
        [(c, *v) for c, v in column_quantiles(df, {c: as_number(c) for c in features}, [0.25, 0.5, 0.75]).items()],
        "feature string, q25 double, q50 double, q75 double")
    return stats.join(q, "feature", "left").select("feature", "count", "mean", "std", "min", "q25", "q50",
                                                   "q75", "max")


def min_max(df: DataFrame, features) -> DataFrame:
    """(feature, min, max) from one wide pass."""
    row = numbers(df, features).agg(*[x for i, c in enumerate(features) for x in (F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"))])
    return _inline(row, "feature", [(c, {"min": F.col(f"_lo{i}"), "max": F.col(f"_hi{i}")})
                                    for i, c in enumerate(features)])


def _bin(x, lo, hi, n: int):
    """Equal-width bin 1..n over [lo, hi], last bin closed; constant column -> bin 1."""
    b = F.when(hi > lo, F.floor((x - lo) * n / (hi - lo)) + 1).otherwise(F.lit(1))
    return F.least(b, F.lit(n)).cast("int")


def histogram(df: DataFrame, features, bins: int = 30) -> DataFrame:
    """(feature, bin, bin_lower, bin_upper, count) per feature, NULLs skipped."""
    mm = {r["feature"]: (r["min"], r["max"]) for r in min_max(df, features).collect()}
    long = to_long(df, features).where(F.col("value").isNotNull())
    long = long.withColumn("_lo", case_lookup("feature", {c: mm[c][0] for c in features})).withColumn(
        "_hi", case_lookup("feature", {c: mm[c][1] for c in features}))
    long = long.withColumn("bin", _bin(F.col("value"), F.col("_lo"), F.col("_hi"), bins))
    width = (F.col("_hi") - F.col("_lo")) / bins
    g = long.groupBy("feature", "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count"))
    return g.select("feature", "bin", (F.col("_lo") + (F.col("bin") - 1) * width).alias("bin_lower"),
                    (F.col("_lo") + F.col("bin") * width).alias("bin_upper"), "count")


def _pair_corr(x, y):
    """Pearson on pairwise-complete rows; NULL when either side is constant (no ANSI error)."""
    xx = F.when(y.isNotNull(), x)
    yy = F.when(x.isNotNull(), y)
    return safe_div(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def correlation_matrix(df: DataFrame, features) -> DataFrame:
    """(feature_x, feature_y, corr) for all ordered pairs, from k(k+1)/2 aggregates in one pass."""
    feats = list(features)
    aggs, items = [], []
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            if j < i:
                continue
            aggs.append(_pair_corr(F.col(a), F.col(b)).alias(f"_r{i}_{j}"))
    row = numbers(df, feats).agg(*aggs)
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            name = f"_r{min(i, j)}_{max(i, j)}"
            items.append(F.struct(F.lit(a).alias("feature_x"), F.lit(b).alias("feature_y"),
                                  F.col(name).alias("corr")))
    return row.select(F.inline(F.array(*items)))


def target_correlation(df: DataFrame, features, target: str) -> DataFrame:
    """(feature, corr) with the target, descending."""
    row = numbers(df, dict.fromkeys([*features, target])).agg(*[_pair_corr(F.col(c), F.col(target)).alias(f"_r{i}") for i, c in enumerate(features)])
    return _inline(row, "feature", [(c, {"corr": F.col(f"_r{i}")}) for i, c in enumerate(features)]
                   ).orderBy(F.desc_nulls_last("corr"), "feature")


def _fences(df: DataFrame, features, multiplier: float) -> dict:
    """Quartiles and fences of each feature that has values."""
    q = column_quantiles(df, {c: as_number(c) for c in features}, [0.25, 0.5, 0.75])
    return {c: dict(q1=q1, median=m, q3=q3, lower=q1 - multiplier * (q3 - q1), upper=q3 + multiplier * (q3 - q1))
            for c, (q1, m, q3) in q.items() if q1 is not None}


def outlier_counts(df: DataFrame, features, multiplier: float = 1.5) -> DataFrame:
    """(feature, lower, upper, outliers, outlier_percent) descending by outliers."""
    b = _fences(df, features, multiplier)
    row = numbers(df, b).agg(F.count("*").alias("rows"), *[
        F.count_if((F.col(c) < f["lower"]) | (F.col(c) > f["upper"])).alias(f"o{i}") for i, (c, f) in enumerate(b.items())]).first()
    out = [(c, f["lower"], f["upper"], row[f"o{i}"], row[f"o{i}"] * 100.0 / row["rows"]) for i, (c, f) in enumerate(b.items())]
    res = df.sparkSession.createDataFrame(
        out, "feature string, lower double, upper double, outliers long, outlier_percent double")
    return res.orderBy(F.desc("outliers"), "feature")


def boxplot_stats(df: DataFrame, features, multiplier: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest data point inside the fences) and flier count."""
    b, aggs = _fences(df, features, multiplier), [F.count("*").alias("rows")]
    for i, (c, f) in enumerate(b.items()):
        v = F.col(c)
        inside = (v >= f["lower"]) & (v <= f["upper"])
        aggs += [F.min(F.when(inside, v)).alias(f"lo{i}"), F.max(F.when(inside, v)).alias(f"hi{i}"), F.count_if(~inside).alias(f"n{i}")]
    row = numbers(df, b).agg(*aggs).first()
    out = [(c, f["q1"], f["median"], f["q3"], row[f"lo{i}"], row[f"hi{i}"], row[f"n{i}"]) for i, (c, f) in enumerate(b.items())]
    return df.sparkSession.createDataFrame(
        out, "feature string, q1 double, median double, q3 double, whisker_low double, whisker_high double, "
             "fliers long")


def pair_density(df: DataFrame, features, target: str, bins: int = 20) -> DataFrame:
    """Counts on a (feature bin x target) grid, the scalable form of a scatter plot."""
    mm = {r["feature"]: (r["min"], r["max"]) for r in min_max(df, features).collect()}
    long = to_long(df.where(F.col(target).isNotNull()), features, ids=[target]).where(F.col("value").isNotNull())
    lo = case_lookup("feature", {c: mm[c][0] for c in features})
    hi = case_lookup("feature", {c: mm[c][1] for c in features})
    long = long.withColumn("x_bin", _bin(F.col("value"), lo, hi, bins))
    return long.groupBy("feature", "x_bin", target).agg(F.count(F.lit(1)).alias("count"))


def eda_report(df: DataFrame, features, target: str) -> DataFrame:
    """Long form (section, key, value double) of D1, D4, D6, D8, D12, D13."""
    shape = profile_shape(df).select(F.lit("shape").alias("section"), F.inline(F.array(
        F.struct(F.lit("rows").alias("key"), F.col("rows").cast("double").alias("value")),
        F.struct(F.lit("columns").alias("key"), F.col("columns").cast("double").alias("value")))))
    nulls = null_counts(df).select(F.lit("null_counts").alias("section"), F.col("column").alias("key"),
                                   F.col("null_count").cast("double").alias("value"))
    dups = duplicate_count(df).select(F.lit("duplicates").alias("section"), F.lit("duplicate_rows").alias("key"),
                                      F.col("duplicate_rows").cast("double").alias("value"))
    dist = value_counts_by_key(df, target).select(F.lit("target_distribution").alias("section"),
                                                  F.col(target).cast("string").alias("key"),
                                                  F.col("count").cast("double").alias("value"))
    corr = target_correlation(df, features, target).select(F.lit("target_correlation").alias("section"),
                                                           F.col("feature").alias("key"),
                                                           F.col("corr").alias("value"))
    outl = outlier_counts(df, features).select(F.lit("outliers").alias("section"),
                                                     F.col("feature").alias("key"),
                                                     F.col("outliers").cast("double").alias("value"))
    return shape.unionByName(nulls).unionByName(dups).unionByName(dist).unionByName(corr).unionByName(outl)
