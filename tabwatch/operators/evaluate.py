"""Multi-class evaluation.

Everything derives from ONE aggregation of the data into (actual, predicted) counts,
which has at most k^2 rows; ROC/AUC derive from one aggregation into
(class, score) positive/negative counts plus bucketed prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.functions.columns import safe_div
from tabwatch.operators.prefix import running_totals
from tabwatch.session import materialize


def _labels_df(spark, labels, name: str = "class") -> DataFrame:
    """The fixed label list as a tiny literal table (size = number of labels)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(int(x)) for x in labels])).alias(name))


def confusion_counts(df: DataFrame, actual: str, predicted: str, by=()) -> DataFrame:
    """(by..., actual, predicted, count) for the pairs that occur; map-side combined."""
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels) -> DataFrame:
    """G1: labels x labels grid with zeros kept."""
    spark = df.sparkSession
    grid = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(int(a)).alias("actual"), F.lit(int(p)).alias("predicted"))
        for a in labels for p in labels])))
    cm = confusion_counts(df, actual, predicted)
    return grid.join(cm, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count"))


def per_class_stats(cm: DataFrame, labels=None, by=()) -> DataFrame:
    """(by..., class, tp, support, predicted_count, precision, recall, f1) from confusion counts.

    labels=None -> classes present in actual or predicted (sklearn's default label set);
    otherwise exactly the given list (absent classes get zeros).
    """
    spark = cm.sparkSession
    by = list(by)
    a = cm.groupBy(*by, F.col("actual").alias("class")).agg(
        F.sum("count").alias("support"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)).alias("tp"))
    p = cm.groupBy(*by, F.col("predicted").alias("class")).agg(F.sum("count").alias("predicted_count"))
    if labels is None:
        classes = a.select(*by, "class").union(p.select(*by, "class")).distinct()
    elif by:
        groups = cm.select(*by).distinct()
        classes = groups.withColumn("class", F.explode(F.array(*[F.lit(int(x)) for x in labels])))
    else:
        classes = _labels_df(spark, labels)
    s = classes.join(a, by + ["class"], "left").join(p, by + ["class"], "left").select(
        *by, "class", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "support",
                                                                                      "predicted_count")])
    return s.select("*",
                    F.coalesce(safe_div(F.col("tp"), F.col("predicted_count")), F.lit(0.0)).alias("precision"),
                    F.coalesce(safe_div(F.col("tp"), F.col("support")), F.lit(0.0)).alias("recall"),
                    F.coalesce(safe_div(2.0 * F.col("tp"), F.col("support") + F.col("predicted_count")),
                               F.lit(0.0)).alias("f1"))


def _mean(c: str):
    """The mean of a group, summed by size: equal classes have the same last bit in any order of rows."""
    total = F.aggregate(F.array_sort(F.collect_list(c)), F.lit(0.0), lambda a, x: a + x)  # one value a class
    return safe_div(total, F.count(c))


def _summary(stats: DataFrame, by=()) -> DataFrame:
    n = F.sum("support")
    return stats.groupBy(*by).agg(
        safe_div(F.sum("tp"), n).alias("accuracy"),
        _mean("precision").alias("precision_macro"), _mean("recall").alias("recall_macro"),
        _mean("f1").alias("f1_macro"),
        F.coalesce(safe_div(F.sum(F.col("precision") * F.col("support")), n), F.lit(0.0)).alias("precision_weighted"),
        F.coalesce(safe_div(F.sum(F.col("recall") * F.col("support")), n), F.lit(0.0)).alias("recall_weighted"),
        F.coalesce(safe_div(F.sum(F.col("f1") * F.col("support")), n), F.lit(0.0)).alias("f1_weighted"),
        n.cast("long").alias("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """G2."""
    return df.agg(safe_div(F.count_if(F.col(actual) == F.col(predicted)), F.count(F.lit(1))).alias("accuracy"))


def macro_prf(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Unweighted means over actual U predicted, zero_division = 0."""
    return _summary(per_class_stats(confusion_counts(df, actual, predicted))).select(
        "precision_macro", "recall_macro", "f1_macro")


def weighted_prf(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Support-weighted means."""
    return _summary(per_class_stats(confusion_counts(df, actual, predicted))).select(
        "precision_weighted", "recall_weighted", "f1_weighted")


def classification_report(df: DataFrame, actual: str, predicted: str, labels, names=None) -> DataFrame:
    """(row, precision, recall, f1, support) per fixed label + accuracy + macro / weighted avg."""
    names = names or {x: str(x) for x in labels}
    stats = per_class_stats(confusion_counts(df, actual, predicted), labels)
    name_map = F.create_map(*[x for k, v in names.items() for x in (F.lit(int(k)), F.lit(v))])
    rows = stats.select(name_map[F.col("class")].alias("row"), "precision", "recall", "f1",
                        F.col("support").cast("long").alias("support"))
    summ = _summary(stats)
    def item(name, p, r, f):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"), F.col("n").alias("support"))

    none = F.lit(None)
    extra = summ.select(F.inline(F.array(
        item("accuracy", none, none, F.col("accuracy")),
        item("macro avg", F.col("precision_macro"), F.col("recall_macro"), F.col("f1_macro")),
        item("weighted avg", F.col("precision_weighted"), F.col("recall_weighted"), F.col("f1_weighted")))))
    return rows.unionByName(extra)


def one_vs_rest(df: DataFrame, actual: str, scores: str, labels, by=()) -> DataFrame:
    """(by..., class, y, score) for every row and label; ``scores`` is array<double> in label order."""
    items = [F.struct(F.lit(int(c)).alias("class"), (F.col(actual) == c).cast("int").alias("y"),
                      F.col(scores)[i].cast("double").alias("score")) for i, c in enumerate(labels)]
    return df.select(*by, F.inline(F.array(*items)))


def score_counts(ovr: DataFrame, by=()) -> DataFrame:
    """(by..., class, score, pos, neg), written once: points and totals are both read from it."""
    return materialize(ovr.groupBy(*by, "class", "score").agg(F.sum("y").cast("long").alias("pos"),
                                                              F.sum(1 - F.col("y")).cast("long").alias("neg")))


def roc_points(counts: DataFrame, lead=(), by=(), **kw) -> DataFrame:
    """(by..., class, score, pos, neg, tps, fps, idx[, next_pos, next_neg]): cumulative counts at
    each distinct score, descending, from ONE (bucketed) prefix-sum pass."""
    by = list(by)
    sc = counts.withColumn("_one", F.lit(1).cast("long"))
    rt = running_totals(sc, by + ["class"], "score", ["pos", "neg", "_one"], descending=True, lead=lead, **kw)
    return rt.select(*by, "class", "score", "pos", "neg", F.col("cum_pos").alias("tps"),
                     F.col("cum_neg").alias("fps"), F.col("cum__one").alias("idx"),
                     *[F.col("next_" + c) for c in lead])


def _class_totals(counts: DataFrame, by=()) -> DataFrame:
    """(by..., class, P, N) straight from the score counts (not from the prefix-sum table)."""
    return counts.groupBy(*by, "class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def roc_curve(ovr: DataFrame, drop_intermediate: bool = True, **kw) -> DataFrame:
    """(class, threshold, fpr, tpr); starts at (0, 0) with threshold +inf.

    An interior point is dropped when it is collinear with its neighbours: the second
    differences of fps and tps are the changes of the per-score increments, so a point is kept
    iff the next score's (pos, neg) differs from its own (first and last points always kept).
    """
    counts = score_counts(ovr)
    pts = roc_points(counts, lead=("pos", "neg"), **kw)
    totals = _class_totals(counts)
    if drop_intermediate:
        keep = ((F.col("idx") == 1) | F.col("next_pos").isNull()
                | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
        pts = pts.where(keep)
    pts = pts.select("class", "score", "tps", "fps")
    origin = totals.select("class", F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("tps"),
                           F.lit(0).cast("long").alias("fps"))
    allp = pts.unionByName(origin).join(totals, "class")
    return allp.select("class", F.col("score").alias("threshold"),
                       safe_div(F.col("fps"), F.col("N")).alias("fpr"),
                       safe_div(F.col("tps"), F.col("P")).alias("tpr"))


def roc_auc_per_class(ovr: DataFrame, by=(), **kw) -> DataFrame:
    """(by..., class, auc, positives, negatives); ties count one half (Mann-Whitney)."""
    by = list(by)
    counts = score_counts(ovr, by)
    pts = roc_points(counts, by=by, **kw)
    j = pts.join(_class_totals(counts, by), by + ["class"])
    below = F.col("N") - F.col("fps")  # negatives with a strictly lower score
    area = F.sum(F.col("pos").cast("double") * (below.cast("double") + F.col("neg") / 2.0))
    return j.groupBy(*by, "class").agg(
        safe_div(area, F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"),
        F.first("P").alias("positives"), F.first("N").alias("negatives"))


def roc_auc_ovr_weighted(ovr: DataFrame, labels, by=(), **kw) -> DataFrame:
    """Prevalence-weighted mean of per-class AUCs; NULL + flag when a label is absent."""
    if not by:
        kw.setdefault("max_groups", len(labels))
    auc = roc_auc_per_class(ovr, by=by, **kw)
    return auc.groupBy(*by).agg(
        F.when(F.count_if(F.col("positives") > 0) == len(labels),
               safe_div(F.sum(F.col("auc") * F.col("positives")), F.sum("positives"))).alias(
            "roc_auc_ovr_weighted"),
        (F.count_if(F.col("positives") > 0) < len(labels)).alias("auc_class_absent"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, scores: str, labels, by=(),
                           **kw) -> DataFrame:
    """The 8-metric row (+ ``auc_class_absent`` flag); one row per ``by`` group."""
    by = list(by)
    summ = _summary(per_class_stats(confusion_counts(df, actual, predicted, by), by=by), by)
    auc = roc_auc_ovr_weighted(one_vs_rest(df, actual, scores, labels, by), labels, by=by, **kw)
    if by:
        return summ.drop("n").join(auc, by, "left")
    return _one_row_join(summ.drop("n"), auc)


def evaluate_split(pred: DataFrame, actual: str, predicted: str, scores: str, labels, names=None) -> DataFrame:
    """The whole report of a model on a split, as (section, key, class, x, value) rows.

    Sections: confusion_matrix (key actual|predicted), precision / recall / f1 / support (key: a label's
    name, accuracy, macro avg or weighted avg), roc_curve (class, x = false-positive rate, value = true-
    positive rate, key = threshold), roc_auc (class) and metrics (G10). ``pred`` is scored once: it is
    written to the shared folder and every section reads that.
    """
    none = F.lit(None).cast("double")
    pred = materialize(pred.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"), F.col(scores).alias("scores")))

    def rows(df: DataFrame, section, key, value, cls=none, x=none) -> DataFrame:
        section = F.lit(section) if isinstance(section, str) else section
        return df.select(section.alias("section"), key.cast("string").alias("key"), cls.cast("int").alias("class"),
                         x.cast("double").alias("x"), value.cast("double").alias("value"))

    cm = confusion_matrix(pred, "actual", "predicted", labels)
    report = classification_report(pred, "actual", "predicted", labels, names)
    parts = ("precision", "recall", "f1", "support")
    long = report.select("row", F.inline(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("double").alias("value")) for c in parts])))
    ovr = one_vs_rest(pred, "actual", "scores", labels)
    roc = roc_curve(ovr, max_groups=len(labels))
    auc = roc_auc_per_class(ovr, max_groups=len(labels))
    met = classification_metrics(pred, "actual", "predicted", "scores", labels)
    met = met.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c, t in met.dtypes if t == "double"])))
    out = rows(cm, "confusion_matrix", F.concat_ws("|", "actual", "predicted"), F.col("count"))
    out = out.unionByName(rows(long, F.col("section"), F.col("row"), F.col("value")))
    out = out.unionByName(rows(roc, "roc_curve", F.col("threshold"), F.col("tpr"), F.col("class"), F.col("fpr")))
    out = out.unionByName(rows(auc, "roc_auc", F.col("class"), F.col("auc"), F.col("class")))
    return out.unionByName(rows(met, "metrics", F.col("key"), F.col("value")))


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row frames on a constant key (both sides are single aggregate rows)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
