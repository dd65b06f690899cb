"""Exact top-k inner products through a pivot-distance index.

Vectors of integers with inner products are laid out as points with distances: a vector x of
norm at most M gets one more coordinate sqrt(M*M - x*x), a query gets 0; then
``distance(q, x)^2 = q*q + M*M - 2 q*x``, so the largest inner products are the nearest points.

Index: every point is keyed by its nearest pivot and its distance to it; the points of a cell,
sorted by that distance, are cut into annuli of about ``BLOCK`` points. For a query at distance
d from the pivot, a point of the annulus [lo, hi] is at least max(lo - d, d - hi, 0) away.

Search: a query first opens the ``FIRST`` annuli with the smallest bounds, which gives it a k-th
best score; then it expands to every other annulus whose bound still allows that score or more,
and to no other. Opened annuli meet their queries by a join on the annulus, in blocks.
Scores are exact while they fit a long: products of doubles that hold integers, with sums below
2^53, else of 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, tasks, written

PIVOTS = 32
BLOCK = 1024
FIRST = 2
#: Bins of the distance to a pivot, in which annuli are planned.
BINS = 4096
#: Queries that meet a block in one task; beyond, the block is sent to several.
TOGETHER = 16_384
#: Bounds (of a query and a block) that a task holds at once.
VISITS = 1 << 21
_POINT = "vec_id long, cell int, distance double, bin int, vector binary"
_VISIT = "block long, query_id long, floor long, vector binary"
_FOUND = "query_id long, vec_id long, score long"


def _points(vectors: np.ndarray, pivots: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot and the distance to it in the space with one more coordinate."""
    own = np.concatenate([vectors, np.sqrt(np.maximum(0.0, m2 - (vectors * vectors).sum(1)))[:, None]], 1)
    d2 = (own * own).sum(1)[:, None] - 2 * own @ pivots.T + (pivots * pivots).sum(1)
    cell = d2.argmin(1)
    return cell, np.sqrt(np.maximum(0.0, np.take_along_axis(d2, cell[:, None], 1)[:, 0]))


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), "<i8").reshape(-1, dim)


def _dots(queries: np.ndarray, points: np.ndarray, largest: float) -> np.ndarray:
    if largest < 2.0 ** 53:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    return queries @ points.T


def _best(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return pdf[pdf.groupby("query_id").cumcount() < k]


def top_k(points: DataFrame, is_query, k: int, scale: int = 256, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k largest inner products with other rows.

    ``points`` has vec_id (long) and embedding (array of numbers); each component becomes
    floor(scale * x). ``is_query`` is a condition on vec_id. Vectors that are null or hold null
    or non-finite components, and null ids, take no part; vectors of different lengths have no inner
    product, so each length is searched by itself (empty vectors score 0 with each other). Components
    whose scaled value does not fit a long saturate there. A row that repeats (same id and vector)
    counts once, and rows that share the query's id are its own. Ties go to the smaller vec_id. Fewer
    candidates than k are all returned. Other columns are ignored; an empty table gives no rows.
    """
    spark = points.sparkSession
    prepare(spark)
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    whole = points.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("v"))
    whole = written(whole.distinct().withColumn("size", F.size("v")), "topk-vectors")
    sizes = [r["size"] for r in whole.groupBy("size").agg(F.count("*").alias("n")).orderBy("size").collect()]  # one row a length
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for size in sizes:
        own = whole.where(F.col("size") == size).drop("size")
        out = out.union(_top_k_of(own, size, is_query, k, pivots, block) if size else _empty_vectors(own, is_query, k))
    if len(sizes) > 1:  # an id may have vectors of several lengths
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = out.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out


def _empty_vectors(whole: DataFrame, is_query, k: int) -> DataFrame:
    """Vectors without components: all scores are 0, so the smallest ids are the answer."""
    ids = [r["vec_id"] for r in whole.select("vec_id").orderBy("vec_id").limit(k + 1).collect()]
    first = F.filter(F.array(*[F.lit(i).cast("long") for i in ids]), lambda i: i != F.col("vec_id"))
    found = whole.where(is_query).select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(first, 1, k)).alias("rank", "vec_id"))
    return found.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))


def _top_k_of(whole: DataFrame, dim: int, is_query, k: int, pivots: int, block: int) -> DataFrame:
    """``top_k`` over distinct vectors (vec_id, v) of one length."""
    spark = whole.sparkSession
    # equal vectors tie, so that only the k + 1 smallest ids of each can be in any answer
    ties = Window.partitionBy("v").orderBy("vec_id")
    kept = whole.withColumn("tie", F.row_number().over(ties)).where(F.col("tie") <= k + 1).drop("tie")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    m2 = float(whole.agg(F.max(norm2)).first()[0])
    sample = whole.orderBy(F.xxhash64("v"), "vec_id").limit(pivots).collect()  # at most ``pivots`` rows
    base = np.unique(np.array([r["v"] for r in sample], np.float64), axis=0)
    base = np.concatenate([base, np.sqrt(np.maximum(0.0, m2 - (base * base).sum(1)))[:, None]], 1)
    far = 2 * np.sqrt(m2) + 1.0  # no two points are further apart
    slack = 1e-9 * max(1.0, m2)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            cell, d = _points(v.astype(np.float64), base, m2)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(cell.astype(np.int32)), pa.array(d), pa.array((d / far * BINS).astype(np.int32)),
                pa.array([r.astype("<i8").tobytes() for r in v], pa.binary())],
                names=["vec_id", "cell", "distance", "bin", "vector"])

    keyed = written(kept.mapInArrow(index, _POINT), "topk-index")
    # annuli: neighbouring bins of a cell up to ``block`` points; PIVOTS * BINS rows at most
    counts = keyed.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.min("distance").alias("lo"),
                                              F.max("distance").alias("hi")).orderBy("cell", "bin").collect()
    plan, annuli = [], []  # (cell, bin, first block, parts), (cell, lo, hi) of each block
    held, last = 0, None
    for r in counts:
        parts = -(-r["n"] // (2 * block))  # a bin with very many points is cut by id
        if parts == 1 and last == r["cell"] and held + r["n"] <= block and plan[-1][3] == 1:
            annuli[-1] = (r["cell"], annuli[-1][1], r["hi"])
            plan.append((r["cell"], r["bin"], len(annuli) - 1, 1))
            held += r["n"]
        else:
            plan.append((r["cell"], r["bin"], len(annuli), parts))
            annuli += [(r["cell"], r["lo"], r["hi"])] * parts
            held = r["n"]
        last = r["cell"]
    table = np.array(annuli, np.float64)
    cells, lo, hi = table[:, 0].astype(int), table[:, 1], table[:, 2]
    blocks = spark.createDataFrame(plan, "cell int, bin int, first long, parts long")
    cut = keyed.join(F.broadcast(blocks), ["cell", "bin"]).select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("block"), "vec_id", "vector")
    cut = written(cut.repartition(tasks(spark), "block").sortWithinPartitions("block"), "topk-blocks")

    queries = whole.where(is_query).select(F.col("vec_id").alias("query_id"), "v")

    def bounds(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest score that each block can hold for each query, and how far off its middle is."""
        qq = (q * q).sum(1)
        d2 = qq[:, None] - 2 * q @ base[:, :-1].T + (base * base).sum(1)
        d = np.sqrt(np.maximum(0.0, d2))[:, cells]
        least = np.maximum(0.0, np.maximum(lo - d, d - hi) - 1e-9 * far)
        return (qq[:, None] + m2 - least * least) / 2 + slack, np.abs(d - (lo + hi) / 2)

    def visits(batches: Iterator[pa.RecordBatch], expand: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(-1, dim)
            floor = b.column(2).to_numpy(zero_copy_only=False) if expand else np.full(len(v), np.iinfo(np.int64).min)
            raw = [r.astype("<i8").tobytes() for r in v]
            ids = b.column(0).to_pylist()
            some = max(1, min(256, VISITS // len(cells)))  # queries against all blocks at once
            for at in range(0, len(v), some):
                most, middle = bounds(v[at:at + some].astype(np.float64))
                order = np.lexsort((middle, -most), axis=1)[:, :FIRST]
                opened = np.zeros(most.shape, bool)
                np.put_along_axis(opened, order, True, 1)
                if expand:
                    opened = ~opened & (most >= floor[at:at + some].astype(np.float64)[:, None])
                i, j = np.nonzero(opened)
                i += at
                if len(i):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(j.astype(np.int64)), pa.array([ids[t] for t in i], pa.int64()),
                        pa.array(floor[i]), pa.array([raw[t] for t in i], pa.binary())],
                        names=["block", "query_id", "floor", "vector"])

    largest = m2 + 1.0

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block against the queries that open it."""
        out = []
        if len(left) and len(right):
            points_, ids = _matrix(right["vector"], dim), right["vec_id"].to_numpy()
            for at in range(0, len(left), 1024):
                part = left.iloc[at:at + 1024]
                q = part["query_id"].to_numpy()
                s = _dots(_matrix(part["vector"], dim), points_, largest)
                s[q[:, None] == ids] = np.iinfo(np.int64).min
                # at least the k best of each row, and all that tie with the last of them
                edge = np.partition(s, max(0, s.shape[1] - k), 1)[:, max(0, s.shape[1] - k)]
                edge = np.maximum(edge, part["floor"].to_numpy())
                i, j = np.nonzero((s >= edge[:, None]) & (s > np.iinfo(np.int64).min))
                out.append(_best(pd.DataFrame({"query_id": q[i], "vec_id": ids[j], "score": s[i, j]}), k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    slots = -(-queries.count() // TOGETHER) or 1
    def search(asked: DataFrame, expand: bool) -> DataFrame:
        opened = asked.repartition(tasks(spark)).mapInArrow(lambda b: visits(b, expand), _VISIT)
        opened = opened.withColumn("slot", F.pmod(F.xxhash64("query_id"), F.lit(slots)).cast("int"))
        if slots > 1:  # a block goes to the slots that open it, to no other
            opened = written(opened, "topk-opened")
            wanted = opened.select(F.col("block").alias("wanted"), F.col("slot").alias("by")).distinct()
            sent = cut.join(wanted, F.col("block") == F.col("wanted")).select("block", F.col("by").alias("slot"), "vec_id", "vector")
        else:
            sent = cut.withColumn("slot", F.lit(0))
        return opened.groupBy("block", "slot").cogroup(sent.groupBy("block", "slot")).applyInPandas(meet, _FOUND)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    near = written(best(search(queries, False)), "topk-near")
    floors = near.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == k, F.col("score"))).alias("floor"))
    lowest = F.lit(-(1 << 62)).cast("long")
    asked = queries.join(floors, "query_id", "left").select("query_id", "v", F.coalesce("floor", lowest).alias("floor"))
    found = near.select("query_id", "vec_id", "score").union(search(asked, True))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
