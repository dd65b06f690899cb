"""Feature preparation: seeded stratified split, then fit on train and apply everywhere.

The fitted state is a small params table (one row per feature: median, lower, upper,
center, scale). Fitting is a few wide aggregates over the columns; applying is one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.functions.columns import as_number, clip, hash_order, hash_unit, missing
from tabwatch.operators.quantiles import column_quantiles, filled_quartiles
from tabwatch.session import materialize
from tabwatch.spec import SplitConfig

_TWO32 = 4294967296.0


# ---------------------------------------------------------------------------
# Seeded ranks inside each class
# ---------------------------------------------------------------------------

def class_ranks(df: DataFrame, label: str, key, seed: int, buckets: int | None = None,
                rank_col: str = "_rank", tied: bool = False) -> DataFrame:
    """1-based rank of each row inside its class, ordered by md5(seed|key) then key. ``tied``: rows with
    equal keys share their first one's rank.

    The md5 prefix is uniform, so fixed hash ranges cut each class into ``buckets`` pieces;
    per-(class, bucket) counts give offsets, and row_number runs inside (class, bucket) only.
    """
    key = list(key)
    spark = df.sparkSession
    nb = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    h = df.withColumn("_h", hash_order(seed, key))
    h = h.withColumn("_b", F.floor(hash_unit("_h") * nb / _TWO32).cast("int"))
    counts = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    wo = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(label, "_b", F.coalesce(F.sum("_bn").over(wo), F.lit(0)).alias("_off"))
    wi = Window.partitionBy(label, "_b").orderBy("_h", *key)
    ranked = h.join(offsets, on=[label, "_b"], how="inner")
    own = F.rank() if tied else F.row_number()
    return ranked.withColumn(rank_col, F.col("_off") + own.over(wi)).drop("_b", "_off", "_bn")


def _largest_remainder(counts: DataFrame, label: str, cnt: str, draws, out: str) -> DataFrame:
    """Allocate ``draws`` (a column) over classes in proportion to ``cnt``; ties -> smallest label.

    ``counts`` has one row per class (tiny), so its un-partitioned windows are cheap.
    """
    total = F.sum(cnt).over(Window.partitionBy())
    cont = F.col(cnt) / total * draws
    c = counts.withColumn("_cont", cont).withColumn("_fl", F.floor("_cont"))
    c = c.withColumn("_rem", F.col("_cont") - F.col("_fl"))
    c = c.withColumn("_need", draws - F.sum("_fl").over(Window.partitionBy()))
    c = c.withColumn("_rr", F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc(label))))
    return c.withColumn(out, (F.col("_fl") + F.when(F.col("_rr") <= F.col("_need"), 1).otherwise(0))
                        .cast("long")).drop("_cont", "_fl", "_rem", "_need", "_rr")


def split_quotas(df: DataFrame, label: str, config: SplitConfig = SplitConfig(), counted: str | None = None) -> DataFrame:
    """Per class: q_test and q_validation, the sizes a stratified two-step split would draw.

    n_test = ceil(t * n) (double arithmetic); train quotas by largest remainder, test = rest.
    Then the same on the remainder with relative size v / (1 - t). ``counted``: ``df`` has counts.
    """
    counts = df.groupBy(label).agg((F.sum(counted) if counted else F.count(F.lit(1))).alias("_c"))
    t = float(config.test_size)
    v_rel = float(config.validation_size) / (1.0 - float(config.test_size))
    n = F.sum("_c").over(Window.partitionBy())
    c = counts.withColumn("_n_train", n - F.ceil(F.lit(t) * n))
    c = _largest_remainder(c, label, "_c", F.col("_n_train"), "_q_train1")
    c = c.withColumn("q_test", F.col("_c") - F.col("_q_train1"))
    c = c.withColumn("_rest", F.col("_q_train1"))
    m = F.sum("_rest").over(Window.partitionBy())
    c = c.withColumn("_n_train2", m - F.ceil(F.lit(v_rel) * m))
    c = _largest_remainder(c, label, "_rest", F.col("_n_train2"), "_q_train2")
    c = c.withColumn("q_validation", F.col("_rest") - F.col("_q_train2"))
    return c.select(label, F.col("_c").alias("class_count"), "q_test", "q_validation")


#: Leading hash digits (hex) that the histogram of a split counts.
SPLIT_DIGITS = 4


def split_cuts(df: DataFrame, label: str, key, config: SplitConfig = SplitConfig()) -> DataFrame:
    """(label, _test, _validation): in the order (md5(seed|key), key) of a class, the last row of the test
    split and of the validation split (null: none).

    A histogram of the leading hash digits, one row for each class and prefix, tells in which prefix a
    cut lies and how far in; only the rows of those prefixes, about 1 / 65536 of a class, are ordered.
    """
    key = list(key)
    h = df.select(label, *key, hash_order(config.seed, key).alias("_h")).withColumn("_p", F.substring("_h", 1, SPLIT_DIGITS))
    counts = materialize(h.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n")))
    quotas = split_quotas(counts, label, config, "_n")
    upto = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.array(F.struct(F.lit(0).alias("cut"), F.col("q_test").alias("rank")),
                    F.struct(F.lit(1).alias("cut"), (F.col("q_test") + F.col("q_validation")).alias("rank")))
    wanted = quotas.select(F.col(label).alias("_l"), F.inline(ranks)).where("rank > 0")
    placed = counts.withColumn("_upto", F.sum("_n").over(upto)).join(F.broadcast(wanted), F.col(label) == F.col("_l"))
    placed = placed.where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_n")))
    placed = placed.select("_l", F.col("_p").alias("_q"), "cut", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_in"))
    placed = F.broadcast(materialize(placed))  # two rows a class
    near = h.join(placed.select("_l", "_q").distinct(), (F.col(label) == F.col("_l")) & (F.col("_p") == F.col("_q")), "left_semi")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", *key)))
    hit = near.join(placed, (F.col(label) == F.col("_l")) & (F.col("_p") == F.col("_q")) & (F.col("_r") == F.col("_in")))
    at = F.struct("_h", *key)
    return hit.groupBy(label).agg(F.max(F.when(F.col("cut") == 0, at)).alias("_test"), F.max(F.when(F.col("cut") == 1, at)).alias("_validation"))


def stratified_split(df: DataFrame, label: str, key, config: SplitConfig = SplitConfig(),
                     split_col: str = "split", buckets: int | None = None) -> DataFrame:
    """Add ``split`` in {train, validation, test}; disjoint, complete, stratified, seeded.

    Rows are compared with the two cuts of their class, one row a class, so they are neither shuffled nor
    sorted. ``buckets``: rank the rows instead (E1's way), with the same result. Rows with equal keys
    fall on one side of a cut.
    """
    key = list(key)
    if buckets is None:
        cuts = materialize(split_cuts(df, label, key, config)).withColumnRenamed(label, "_l")
        at = F.struct(hash_order(config.seed, key).alias("_h"), *key)
        # every class has a cut unless both of its quotas are 0: its rows are train, those without a class are left out
        j = df.where(F.col(label).isNotNull()).join(F.broadcast(cuts), F.col(label) == F.col("_l"), "left")
        split = (F.when(at <= F.col("_test"), F.lit("test")).when(at <= F.col("_validation"), F.lit("validation")).otherwise(F.lit("train")))
        return j.withColumn(split_col, split).drop("_l", "_test", "_validation")
    quotas = split_quotas(df, label, config)
    ranked = class_ranks(df, label, key, config.seed, buckets, tied=True)
    j = ranked.join(quotas, on=label, how="inner")
    split = (F.when(F.col("_rank") <= F.col("q_test"), F.lit("test"))
             .when(F.col("_rank") <= F.col("q_test") + F.col("q_validation"), F.lit("validation"))
             .otherwise(F.lit("train")))
    return j.withColumn(split_col, split).select(*df.columns, split_col)  # the join put the label first


def stratified_folds(df: DataFrame, label: str, key, k: int = 3, seed: int = 42,
                     fold_col: str = "fold", buckets: int | None = None) -> DataFrame:
    """fold = (class offset + rank - 1) mod k, so every fold is class balanced."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(label, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_coff"))
    ranked = class_ranks(df, label, key, seed, buckets)
    j = ranked.join(offs, on=label, how="inner")
    return j.withColumn(fold_col, ((F.col("_coff") + F.col("_rank") - 1) % k).cast("int")).drop(
        "_rank", "_h", "_coff")


# ---------------------------------------------------------------------------
# Fits (params tables) and applies (one projection)
# ---------------------------------------------------------------------------

def _numbers(features) -> dict:
    return {c: as_number(c) for c in features}


def fit_median(df: DataFrame, features) -> DataFrame:
    """(feature, median) exact, NULL / NaN skipped; NULL for a feature without values."""
    q = column_quantiles(df, _numbers(features), [0.5])
    return df.sparkSession.createDataFrame([(c, v[0]) for c, v in q.items()], "feature string, median double")


def _params(params: DataFrame) -> dict:
    """Collect a params table: one row per feature, bounded by the feature count."""
    return {r["feature"]: r.asDict() for r in params.collect()}


def impute_median(df: DataFrame, params, features=None) -> DataFrame:
    """C2 apply: NULL or NaN -> fitted median."""
    p = params if isinstance(params, dict) else _params(params)
    features = features or list(p)
    return df.withColumns({c: F.coalesce(as_number(c), F.lit(p[c]["median"]).cast("double"))
                           for c in features if c in p})


def fit_iqr_bounds(df: DataFrame, features, multiplier: float = 1.5) -> DataFrame:
    """(feature, q1, q3, lower, upper) with lower = q1 - m*iqr, upper = q3 + m*iqr; features
    without values are left out."""
    q = column_quantiles(df, _numbers(features), [0.25, 0.75])
    rows = [(c, q1, q3, q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)) for c, (q1, q3) in q.items() if q1 is not None]
    return df.sparkSession.createDataFrame(rows, "feature string, q1 double, q3 double, lower double, upper double")


def clip_iqr(df: DataFrame, params, features=None) -> DataFrame:
    """C4: clip to [lower, upper]; NULL stays NULL."""
    p = params if isinstance(params, dict) else _params(params)
    features = features or list(p)
    return df.withColumns({c: clip(c, F.lit(p[c]["lower"]), F.lit(p[c]["upper"]))
                           for c in features if c in p})


def fit_scaler(df: DataFrame, features, scaling: str = "standard") -> DataFrame:
    """C5 / C6 / C7 fit: (feature, center, scale) from one wide aggregate pass.

    standard: center = mean, scale = population std, 1 when the column is constant.
    minmax:   center = min, scale = max - min, 1 when the range is 0.
    none:     center 0, scale 1.
    """
    if scaling not in ("standard", "minmax", "none"):
        raise ValueError(f"unknown scaling option: {scaling!r}")
    aggs = []
    for c in features:
        x = as_number(c)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    row = df.agg(*aggs)
    structs = []
    for c in features:
        mean, std, lo, hi = (F.col(f"{c}__{s}") for s in ("mean", "std", "min", "max"))
        const = lo == hi
        if scaling == "standard":
            center, scale = mean, F.when(const, F.lit(1.0)).otherwise(std)
        elif scaling == "minmax":
            center, scale = lo, F.when(const, F.lit(1.0)).otherwise(hi - lo)
        else:
            center, scale = F.lit(0.0), F.lit(1.0)
        structs.append(F.struct(F.lit(c).alias("feature"), center.cast("double").alias("center"),
                                scale.cast("double").alias("scale")))
    return row.select(F.inline(F.array(*structs)))


def scale(df: DataFrame, params, features=None) -> DataFrame:
    """C5 / C6 apply: (x - center) / scale."""
    p = params if isinstance(params, dict) else _params(params)
    features = features or list(p)
    return df.withColumns({c: (as_number(c) - F.lit(p[c]["center"])) / F.lit(p[c]["scale"])
                           for c in features if c in p})


def fit_preparation(train: DataFrame, features, multiplier: float = 1.5, scaling: str = "standard") -> DataFrame:
    """C8 fit: median -> IQR bounds on imputed train -> scaler on clipped train.

    Quantiles are bracketed (no shuffle of the rows); the quartiles after imputation follow from the
    values' own order, so nothing is bracketed twice. The scaler moments are taken about the median
    in one scan: four scans in all. Returns the params table (feature, median, q1, q3, lower, upper,
    center, scale); a feature without any value raises ValueError.
    """
    if scaling not in ("standard", "minmax", "none"):
        raise ValueError(f"unknown scaling option: {scaling!r}")
    feats = list(features)
    found = filled_quartiles(train, _numbers(feats))
    empty = [f for f in feats if found[f] is None]
    if empty:
        raise ValueError(f"no value to fit the preparation of: {empty}")
    med = {f: found[f][0] for f in feats}
    q = {f: found[f][1:] for f in feats}
    filled = {f: F.coalesce(F.col(f), F.lit(med[f])) for f in feats}
    lower = {f: q1 - multiplier * (q3 - q1) for f, (q1, q3) in q.items()}
    upper = {f: q3 + multiplier * (q3 - q1) for f, (q1, q3) in q.items()}
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(feats):
        v = clip(filled[f], F.lit(lower[f]), F.lit(upper[f]))
        d = v - F.lit(med[f])  # about the median, which keeps the variance well conditioned
        aggs += [F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"t{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    m = train.select(*[as_number(f).alias(f) for f in feats]).agg(*aggs).first()
    m1 = {f: {"lo": m[f"lo{i}"], "hi": m[f"hi{i}"]} for i, f in enumerate(feats)}
    mean = {f: med[f] + m[f"s{i}"] / m["n"] for i, f in enumerate(feats)}
    var = {f: max(m[f"t{i}"] / m["n"] - (m[f"s{i}"] / m["n"]) ** 2, 0.0) for i, f in enumerate(feats)}
    rows = []
    for f in feats:
        const = m1[f]["lo"] == m1[f]["hi"]
        if scaling == "standard":
            center, scale_ = mean[f], 1.0 if const else var[f] ** 0.5
        elif scaling == "minmax":
            center, scale_ = m1[f]["lo"], 1.0 if const else m1[f]["hi"] - m1[f]["lo"]
        else:
            center, scale_ = 0.0, 1.0
        rows.append((f, float(med[f]), float(q[f][0]), float(q[f][1]), float(lower[f]), float(upper[f]),
                     float(center), float(scale_)))
    return train.sparkSession.createDataFrame(
        rows, "feature string, median double, q1 double, q3 double, lower double, upper double, center double, "
              "scale double")


def apply_preparation(df: DataFrame, params, features=None, keep=()) -> DataFrame:
    """Impute -> clip -> scale as ONE projection; columns in feature order, then ``keep``."""
    p = params if isinstance(params, dict) else _params(params)
    features = list(features or p)
    exprs = []
    for c in features:
        r = p[c]
        x = F.coalesce(as_number(c), F.lit(r["median"]).cast("double"))
        x = clip(x, F.lit(r["lower"]), F.lit(r["upper"]))
        x = (x - F.lit(r["center"])) / F.lit(r["scale"])
        exprs.append(x.alias(c))
    return df.select(*exprs, *keep)


def fit_transform_preparation(splits: DataFrame, features, split_col: str = "split", keep=(),
                              multiplier: float = 1.5, scaling: str = "standard"):
    """Fit on the train split, apply to all splits. Returns (prepared, params)."""
    params = fit_preparation(splits.where(F.col(split_col) == "train"), features, multiplier, scaling)
    p = _params(params)
    return apply_preparation(splits, p, features, keep=[split_col, *keep]), params


def preparation_report(raw: DataFrame, deduped: DataFrame, splits: DataFrame, label: str,
                       split_col: str = "split", copies: str | None = None) -> DataFrame:
    """Long form (section, key, value double). ``copies``: ``raw`` has one row a group of equal rows, and
    this column counts them."""
    groups = raw.groupBy(*raw.columns).agg(F.count(F.lit(1)).alias("_cnt")) if copies is None else raw.select(F.col(copies).alias("_cnt"))
    dup = groups.agg(
        F.sum("_cnt").cast("double").alias("rows_before_deduplication"),
        F.count(F.lit(1)).cast("double").alias("rows_after_deduplication"),
        F.sum(F.col("_cnt") - 1).cast("double").alias("duplicates_removed"))
    dup_l = dup.select(F.lit("deduplication").alias("section"),
                       F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))
                                          for c in dup.columns])))
    nulls = deduped.agg(*[F.count_if(missing(deduped, c)).cast("double").alias(c) for c in deduped.columns])
    nulls_l = nulls.select(F.lit("null_counts").alias("section"),
                           F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))
                                              for c in deduped.columns])))
    dist_full = deduped.where(F.col(label).isNotNull()).groupBy(label).count().select(
        F.lit("label_distribution_full").alias("section"), F.col(label).cast("string").alias("key"),
        F.col("count").cast("double").alias("value"))
    dist_split = splits.groupBy(split_col, label).count().select(
        F.concat(F.lit("label_distribution_"), F.col(split_col)).alias("section"),
        F.col(label).cast("string").alias("key"), F.col("count").cast("double").alias("value"))
    shapes = splits.groupBy(split_col).count().select(
        F.lit("shape_rows").alias("section"), F.col(split_col).alias("key"),
        F.col("count").cast("double").alias("value"))
    return dup_l.unionByName(nulls_l).unionByName(dist_full).unionByName(dist_split).unionByName(shapes)

