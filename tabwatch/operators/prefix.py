"""Ordered prefix sums, positions and exact quantiles without a single-partition window.

``Window.partitionBy(g).orderBy(v)`` puts each group on one task. With 3 classes or 11
features that is 3-11 tasks whatever the data size, and a hot group lands on one task.
Here the (already aggregated) rows of each group are cut into ``buckets`` ranges by
approximate quantile edges (only groups whose own count is above the limit), per-(group, bucket)
totals give each bucket's offset, and the running sum is taken inside (group, bucket) windows only. Equal values share a bucket, so
ties stay whole and the result is exact and deterministic.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.session import materialize

#: Rows (one for each group and value) of a bucket.
ROWS_PER_BUCKET = 1_000_000
#: Most buckets of one group.
MOST_BUCKETS = 100_000


def plan_buckets(df: DataFrame, group, order: str, rows_per_bucket: int, buckets: int | None = None,
                 max_groups: int | None = None) -> tuple[DataFrame | None, int]:
    """(group..., _edges) for the groups that need more than one bucket, and the most edges of one.

    A group's buckets follow from its own count, so small groups (all others) have no row and no
    edges however many there are; the plan has at most 2 * rows / ``rows_per_bucket`` edges. None
    if no group is that large. ``buckets`` sets the number for every group. Callers that also use
    the frame for totals write it first (``materialize``): the counts then read those files.
    """
    group = list(group)
    if buckets is not None:
        if buckets <= 1:
            return None, 0
        large, most = df, int(buckets)
        own = F.lit(most)
    else:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        largest = sizes.agg(F.max("_size")).first()[0] or 0
        if largest <= rows_per_bucket:
            return None, 0
        most = min(MOST_BUCKETS, math.ceil(largest / rows_per_bucket))
        sizes = sizes.where(F.col("_size") > rows_per_bucket).select(*[F.col(g).alias("_p_" + g) for g in group], "_size")
        same = [F.col(g).eqNullSafe(F.col("_p_" + g)) for g in group]
        large = df.join(sizes, same)
        own = F.least(F.lit(most), F.ceil(F.max("_size") / rows_per_bucket))
    at = F.percentile_approx(order, [i / most for i in range(1, most)], max(10_000, 10 * most))
    edges = large.groupBy(*group).agg(at.alias("_all"), own.cast("int").alias("_own"))
    some = F.transform(F.sequence(F.lit(1), F.col("_own") - 1), lambda i: F.element_at("_all", F.greatest(
        F.lit(1), (i * most / F.col("_own")).cast("int"))))
    edges = edges.select(*group, some.alias("_edges"))
    return _fixed_edges(edges, most, max_groups), most - 1


def add_buckets(df: DataFrame, group, order: str, plan: DataFrame, most: int, name: str = "_bucket") -> DataFrame:
    """``df`` with the bucket of each row: the edges of its group below ``order`` (0 without a plan row)."""
    keyed = plan.select(*[F.col(g).alias("_p_" + g) for g in group], "_edges")
    j = df.join(keyed, [F.col(g).eqNullSafe(F.col("_p_" + g)) for g in group], "left").drop(*["_p_" + g for g in group])
    bucket = F.when(F.col("_edges").isNotNull(), _edge_index_bsearch(F.col("_edges"), F.col(order), most)).otherwise(0)
    return j.withColumn(name, bucket.cast("int")).drop("_edges")


def _edge_index_bsearch(edges: F.Column, value: F.Column, n_edges: int) -> F.Column:
    """Number of edges strictly below ``value`` (edges sorted ascending): a binary search as a fold."""
    steps = max(1, math.ceil(math.log2(n_edges + 1)))
    init = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.shiftright(lo + hi, 1)
        below = F.element_at(edges, mid + 1) < value
        nxt = F.when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi"))).otherwise(
            F.struct(lo.alias("lo"), mid.alias("hi")))
        return F.when(lo < hi, nxt).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda acc: acc["lo"])


EDGE_BROADCAST_BYTES = 64 * 1024 * 1024


def _fixed_edges(edges: DataFrame, nb: int, max_groups: int | None) -> DataFrame:
    """Make the bucket edges identical for every task that uses them, also after a failure.

    Approximate-percentile sketches merge in shuffle-arrival order, so a recomputed edges stage
    could differ slightly and put a row in another bucket than the offsets assumed. A broadcast
    is built once on the driver and never recomputed: used when the caller bounds the number of
    groups (features, classes); the table is then max_groups rows of nb-1 doubles. Otherwise the
    edges are checkpointed to the shared folder and every recomputation reads the same files.
    """
    if max_groups is not None and max_groups * nb * 8 <= EDGE_BROADCAST_BYTES:
        return F.broadcast(edges)
    return materialize(edges)


def running_totals(df: DataFrame, group, order: str, measures, *, descending: bool = False,
                   buckets: int | None = None, prefix: str = "cum_", lead=(),
                   max_groups: int | None = None) -> DataFrame:
    """Add ``cum_<m>``: inclusive running sum of each measure within ``group`` ordered by ``order``.

    ``df`` must hold at most one row per (group, order) value; aggregate first so that a hot
    value is one row. ``order`` must be numeric for the bucketed path. ``lead`` columns get a
    ``next_<c>`` column: the value on the next row in order (NULL on the last row of a group),
    also across bucket boundaries.
    """
    group = list(group)
    measures = list(measures)
    lead = list(lead)
    if not group:
        # A constant group key keeps one code path (joins stay equi-joins).
        out = running_totals(df.withColumn("_g0", F.lit(0)), ["_g0"], order, measures,
                             descending=descending, buckets=buckets, prefix=prefix, lead=lead, max_groups=1)
        return out.drop("_g0")
    plan, most = plan_buckets(df, group, order, ROWS_PER_BUCKET, buckets, max_groups)
    ordc = F.col(order).desc() if descending else F.col(order).asc()
    if plan is None:
        w = Window.partitionBy(*group).orderBy(ordc)
        wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(m).over(wr).alias(prefix + m) for m in measures],
                         *[F.lead(c).over(w).alias("next_" + c) for c in lead])

    b = add_buckets(df, group, order, plan, most)
    if descending:
        b = b.withColumn("_bucket", -F.col("_bucket"))

    # Per (group, bucket): totals -> offsets of earlier buckets, and (for lead) the first row of
    # the next non-empty bucket. Both tables have a row for each bucket that holds rows.
    aggs = [F.sum(m).alias("_t_" + m) for m in measures]
    if lead:
        first = (F.max_by if descending else F.min_by)(F.struct(*[F.col(c) for c in lead]), F.col(order))
        aggs.append(first.alias("_first"))
    totals = b.groupBy(*group, "_bucket").agg(*aggs)
    wb = Window.partitionBy(*group).orderBy("_bucket")
    side_cols = [F.coalesce(F.sum("_t_" + m).over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)).alias("_o_" + m) for m in measures]
    if lead:
        side_cols.append(F.lead("_first").over(wb).alias("_nextfirst"))
    side = totals.select(*group, "_bucket", *side_cols)
    side = side.select(*[F.col(c).alias("_s_" + c) for c in group + ["_bucket"]], *[c for c in side.columns if c not in group + ["_bucket"]])
    b = b.join(side, [F.col(c).eqNullSafe(F.col("_s_" + c)) for c in group + ["_bucket"]]).drop(*["_s_" + c for c in group + ["_bucket"]])
    wi = Window.partitionBy(*group, "_bucket").orderBy(ordc)
    wir = wi.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.select("*", *[(F.col("_o_" + m) + F.sum(m).over(wir)).alias(prefix + m) for m in measures],
                   *[F.coalesce(F.lead(c).over(wi), F.col("_nextfirst")[c]).alias("next_" + c) for c in lead])
    return out.drop("_bucket", "_nextfirst", *["_o_" + m for m in measures])


def positions(df: DataFrame, group, order: str, *, descending: bool = False, name: str = "pos",
              **kw) -> DataFrame:
    """1-based position of each (distinct) ``order`` value within its group."""
    marked = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(marked, group, order, ["_one"], descending=descending, **kw)
    return out.withColumnRenamed("cum__one", name).drop("_one")


def value_counts_long(df: DataFrame, group, value: str, weight: str | None = None) -> DataFrame:
    """(group..., value, _n): non-null, non-NaN values counted (map-side combined)."""
    v = F.col(value)
    ok = v.isNotNull() & ~F.isnan(v)
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(ok).groupBy(*group, value).agg(n.alias("_n"))


def exact_quantiles(df: DataFrame, group, value: str, probs, *, value_counts: bool = False, **kw) -> DataFrame:
    """Exact linear-interpolation quantiles per group (``percentile`` / ``quantile_cont``) for many groups.

    Returns (group..., p, q): a count per (group, value), written once, bucketed prefix sums, and a
    join with the #groups x #probs x 2 wanted ranks; no group is ever collected in one task. For
    whole columns see ``quantiles.column_quantiles``.
    """
    group = list(group)
    counts = materialize(df if value_counts else value_counts_long(df, group, value))
    kw.setdefault("max_groups", None)
    cum = running_totals(counts, group, value, ["_n"], **kw)
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    tg = ["_tg_" + g for g in group]
    targets = (totals
               .select(*[F.col(g).alias(t) for g, t in zip(group, tg)],
                       F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "_total")
               .withColumn("_pos", (F.col("_total") - 1).cast("double") * F.col("p"))
               .withColumn("_k", F.explode(F.array_distinct(F.array(
                   F.floor("_pos").cast("long"), F.ceil("_pos").cast("long"))))))
    cond = [F.col(t) == F.col(g) for g, t in zip(group, tg)] + [
        F.col("_k") >= F.col("cum__n") - F.col("_n"), F.col("_k") < F.col("cum__n")]
    hit = targets.join(cum, on=cond, how="inner").select(
        *group, "p", "_pos", F.col(value).alias("_v"))
    agg = hit.groupBy(*group, "p", "_pos").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    frac = F.col("_pos") - F.floor("_pos")
    q = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(
        F.col("_lo") + frac * (F.col("_hi") - F.col("_lo")))
    return agg.select(*group, "p", q.alias("q"))
