import math

import numpy as np
from pyspark.sql import functions as F
from tabwatch.llm import topk

SCHEMA = "vec_id long, embedding array<double>, v string, tie string, cell string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, every, k):
    own = {(r[0], tuple(math.floor(256 * x) for x in r[1])) for r in rows
           if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])}
    out = []
    for q in {i for i, _ in own}:
        if q % every == 0:
            mine = [x for i, x in own if i == q]
            best = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in own for x in mine if i != q and len(x) == len(v))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def told(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_the_k_best_with_many_annuli(spark, monkeypatch):
    monkeypatch.setattr(topk, "TOGETHER", 4)
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 8))
    x = middle[rng.integers(0, 6, 300)] * rng.uniform(0.2, 2, (300, 1)) + rng.normal(size=(300, 8)) * 0.3
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[10].tolist()) for k in range(30)] + [(5, x[5].tolist())]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=5, pivots=5, block=16)
    assert told(got) == brute(rows, 10, 5)


def test_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.25, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("-inf"), 1.0]), (None, [1.0, 1.0]),
            (6, [0.0, 0.0]), (50, [0.1, 0.1]), (7, [1.0, 2.0, 3.0]), (50, [0.1, 0.1])]
    query = F.col("vec_id") % 50 == 0
    assert told(topk.top_k(table(spark, rows), query, k=5)) == brute(rows, 50, 5)
    assert told(topk.top_k(table(spark, [(0, [1.0])]), query, k=5)) == []
    assert told(topk.top_k(table(spark, []), query, k=5)) == []


def test_large_numbers_stay_exact(spark):
    rows = [(k, [1e6 + k, -3e5 * k]) for k in range(0, 40)]
    assert told(topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, k=3)) == brute(rows, 10, 3)


def test_every_length_is_searched(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [0.5, 0.5, 1.0]), (2, [1.0, 1.0, 1.0]), (100, [3.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, []), (150, []), (5, []),
            (100, [])]
    assert told(topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, k=2)) == brute(rows, 50, 2)
