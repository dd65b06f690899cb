import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helpers import documents, edge_rows, prose
from tabwatch.llm import balltree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(rows, items, k):
    docs = [(d, split(t)) for d, t, _ in rows]
    docs = [(d, w, Counter(w)) for d, w in docs if w]
    n_docs, n_terms = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, w, c in docs:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(map(str, out))


def told(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé7") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    rows = [(i, prose(rng, rng.choice([1, 5, 30, 200]), words).title() if rng.random() < 0.9 else "again and again", "s") for i in range(n)]
    items = [(i, ", ".join(prose(rng, 12, words).split())) for i in range(30)] + [(3, "more-words again"), (None, "and"), (50, None), (51, "?!")]
    return rows, items


@pytest.mark.parametrize("k,together", [(1, 512), (7, 512), (50, 4)])
def test_against_brute_force(spark, monkeypatch, k, together):
    monkeypatch.setattr(balltree, "BLOCK", 150)
    monkeypatch.setattr(balltree, "LEAF", 8)
    rows, items = corpus(k, 700)
    asked = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, score string")
    assert told(balltree.rank_documents(documents(spark, rows).repartition(3), asked, k, together)) == brute(rows, items, k)


def test_odd_rows(spark):
    rows = edge_rows()
    items = [(1, "Words two A"), (2, "日本語 café"), (3, "word5 and same"), (4, None), (5, "endoftext"), (5, "TEXT")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert told(balltree.rank_documents(documents(spark, rows), asked)) == brute(rows, items, 50)


def test_empty_tables(spark):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert balltree.rank_documents(documents(spark, []), asked).count() == 0
    assert balltree.rank_documents(documents(spark, [(1, "a", "s")]), asked.where("item_id > 1")).count() == 0
    assert balltree.rank_documents(documents(spark, [(1, None, "s"), (2, "b", "s")]), asked).count() == 0


def test_bounds_hold_and_prune():
    """No node's bound is below a member's score; far clusters are not opened."""
    rng = np.random.default_rng(3)
    size, docs = 60, []
    for i in range(2000):
        docs.append((i, np.arange(20 * (i % 3), 20 * (i % 3) + 12), rng.integers(9 * 10**8, 10**9, 12)))
    ptr = np.append(0, np.cumsum([len(d[1]) for d in docs]))
    rows = balltree.Rows(ptr, np.concatenate([d[1] for d in docs]), np.concatenate([d[2] for d in docs]))
    order, nodes = balltree.grow(rows, size)
    assert sorted(order) == list(range(2000))
    q = np.zeros(size, np.int64)
    q[[1, 4, 7, 11]] = 1
    scores = rows.dot(q)
    for lo, hi, child, radius, centre in nodes:
        assert (centre @ q + radius * 2) * (1 + 1e-9) + 1 >= scores[order[lo:hi]].max()
    tree = next(balltree._trees(iter([_batch(docs)]), np.ones(size, np.int64), 1, 1))
    best = balltree.Best(1, 5)
    opened = balltree.visit({c: tree.column(i)[0].as_buffer() for i, c in enumerate(tree.schema.names)}, best, np.array([0, 4]),
                            np.array([1, 4, 7, 11]), size)
    assert 0 < opened < sum(n[2] < 0 for n in nodes)


def _batch(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([
        pa.array([d[0] for d in docs]), pa.array([1] * len(docs)), pa.array([d[1].astype("<i4").tobytes() for d in docs]),
        pa.array([np.maximum(1, d[2] // 10**6).astype("<i8").tobytes() for d in docs])], names=["doc_id", "n", "ids", "tfs"])
