import os

import numpy as np
import pytest

from tabwatch.llm import vecjoin
from tabwatch.llm.common import connected_components

SCHEMA = "vec_id long, embedding array<double>, rep string, size string, cell string"


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA.replace("double", kind))


def fine(r):
    return r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])


def brute(rows, t):
    scaled = [np.array(r[1], float) / max(map(abs, r[1])) if fine(r) else None for r in rows]
    unit = [None if x is None else x / np.linalg.norm(x) for x in scaled]
    n, linked = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                linked[i].append(j)
    comp = {r[0]: r[0] for r in rows if r[0] is not None}
    moved = True
    while moved:
        moved = False
        for i in range(n):
            for j in linked[i]:
                low = min(comp[rows[i][0]], comp[rows[j][0]])
                for k in (i, j):
                    if comp[rows[k][0]] != low:
                        comp[rows[k][0]], moved = low, True
    return [(r[0], len(linked[k]), comp.get(r[0]) if fine(r) else r[0], (r[0] is not None and (comp[r[0]] if fine(r) else r[0]) == r[0]))
            for k, r in enumerate(rows)]


def near(rng, n, dim, groups):
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 0.35], (n, 1))


def told(df):
    return sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_all_links_are_counted(spark, monkeypatch, kind):
    for name, value in (("CELL", 40), ("HOMES", 16), ("STREAMED", 32), ("BINS", 16)):
        monkeypatch.setattr(vecjoin, name, value)
    rng = np.random.default_rng(4)
    x = near(rng, 260, 6, 9).astype(np.float32).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(500 + k, x[7].tolist()) for k in range(40)] + [(600, (x[7] * 3).tolist())]  # copies, and a multiple
    rng.shuffle(rows)
    assert told(vecjoin.range_join(table(spark, rows, kind), 0.9)) == sorted(map(str, brute(rows, 0.9)))


def test_vectors_are_written_a_few_times_however_many_blocks_they_meet(spark, monkeypatch):
    """In 32 dimensions the pivots part little: blocks meet most others, and none is copied for it."""
    for name, value in (("CELL", 20), ("HOMES", 16), ("STREAMED", 32)):
        monkeypatch.setattr(vecjoin, name, value)
    folders = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffled():
        return sum(os.path.getsize(os.path.join(d, f)) for top in folders for d, _, names in os.walk(top) for f in names if f.endswith(".data"))

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(800, 32)), near(rng, 60, 32, 2), rng.normal(size=32) + rng.normal(size=(60, 32)) * 0.01])
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32).astype(float))]
    rng.shuffle(rows)
    before = shuffled()
    got = told(vecjoin.range_join(table(spark, rows, "float"), 0.9))
    sent = shuffled() - before
    assert got == sorted(map(str, brute(rows, 0.9)))
    assert sent < 8 * len(rows) * (32 * 4 + 4 * 8)  # vectors with two key halves, id and number


def test_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []),
            (8, [2.0, 0.1]), (8, [2.0, 0.1]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e-300, 1e-302]), (12, [1e200, 1e198]), (1, [0.0, 1.0])]
    assert told(vecjoin.range_join(table(spark, rows), 0.9)) == sorted(map(str, brute(rows, 0.9)))
    assert vecjoin.range_join(table(spark, []), 0.9).count() == 0
    with pytest.raises(ValueError):
        vecjoin.range_join(table(spark, []), 1.5)


def test_components_of_long_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    chain = rng.permutation(200).tolist()
    edges = list(zip(chain, chain[1:])) + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[k] == 1000 for k in range(1000, 1100)) and got[5001] == 5000
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
