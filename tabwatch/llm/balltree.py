"""Ranked lexical search: exact inner products through sparse ball trees.

A document is a sparse vector over the terms that any item holds: weight of the term times the
saturated count, both integers. An item is a vector of ones, so that a score is an inner product.

Trees: documents are taken in blocks of at most ``BLOCK``; a node is split in two halves along
the line between two documents far apart, down to leaves of ``LEAF``. A node keeps its centroid c
and a radius r that no member exceeds; then ``q x <= q c + |q| r`` for every member x. Radii and
bounds are rounded up by more than what double arithmetic can lose, scores at the leaves are
64-bit integers. A block's tree is one row of a table (compressed sparse rows, documents in leaf
order), so the index is written once and searched from there.

Search: a task goes through its trees; nodes wait in a heap by the largest bound over the items
that still need them, and an item needs a node only while the bound reaches its k-th best score
so far. The k best of every task are merged. The items come in blocks of ``TOGETHER``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, utf8, written

BLOCK = 4096
#: Entries of a block's vectors.
BLOCK_ENTRIES = 1 << 19
LEAF = 64
#: Items that are searched for together.
TOGETHER = 512
#: Terms are maximal runs of these bytes: ASCII letters (lower-cased) and digits, all bytes of other characters.
_TERMS = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)).lower() + bytes(range(128, 256))
_NEVER = -(1 << 62)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def saturated(tf: np.ndarray, n: int, rows: int, length: int) -> np.ndarray:
    """Counts of the terms of a document of ``n`` terms, damped; all in 64-bit integers."""
    m = 100 - 50 + (50 * n * rows) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(rows: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


_VECTORS = "kind int, doc_id long, n long, ids binary, tfs binary"


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Documents with terms as counts of the vocabulary's terms (kind 0); at the end of a task, kind 1:
    its documents and terms (n = -1 and -2 as keys) and the documents that hold each term."""
    names, types = [x.split()[0] for x in _VECTORS.split(", ")], [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    size = len(vocabulary)
    df, rows, length = np.zeros(size, np.int64), 0, 0
    get = vocabulary.get
    for b in batches:
        split = [terms(t.as_buffer().to_pybytes()) for t in b.column(1)]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows, length = rows + int((counts > 0).sum()), length + int(counts.sum())
        ids = np.fromiter((get(t, -1) for t in chain.from_iterable(split)), np.int64, counts.sum())
        owner = np.repeat(np.arange(len(split)), counts)
        keys, tf = np.unique((owner * size + ids)[ids >= 0], return_counts=True)
        owner, ids = keys // max(size, 1), keys % max(size, 1)
        np.add.at(df, ids, 1)
        cut = np.searchsorted(owner, np.arange(len(split) + 1))
        ids, tf = ids.astype("<i4"), tf.astype("<i8")
        out = [(0, doc, n, ids[lo:hi].tobytes(), tf[lo:hi].tobytes())
               for doc, n, lo, hi in zip(b.column(0).to_pylist(), counts.tolist(), cut[:-1].tolist(), cut[1:].tolist()) if hi > lo]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=names)
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.ones(len(held) + 2, np.int32)), pa.array([-1, -2, *held.tolist()], pa.int64()),
        pa.array([rows, length, *df[held].tolist()], pa.int64()), pa.nulls(len(held) + 2, pa.binary()), pa.nulls(len(held) + 2, pa.binary())],
        names=names)


class Rows:
    """Sparse rows: ``ptr``, ``ids``, ``data`` (integers or doubles); no row is empty."""

    def __init__(self, ptr: np.ndarray, ids: np.ndarray, data: np.ndarray):
        self.ptr, self.ids, self.data = ptr, ids, data

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> "Rows":
        n = np.diff(self.ptr)[rows]
        ptr = np.append(0, np.cumsum(n))
        at = np.arange(ptr[-1]) + np.repeat(self.ptr[rows] - ptr[:-1], n)
        return Rows(ptr, self.ids[at], self.data[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.data * dense[self.ids], self.ptr[:-1])

    def dense(self, row: int, size: int) -> np.ndarray:
        out = np.zeros(size)
        out[self.ids[self.ptr[row]:self.ptr[row + 1]]] = self.data[self.ptr[row]:self.ptr[row + 1]]
        return out


def grow(rows: Rows, size: int) -> tuple[np.ndarray, list[tuple[int, int, int, float, np.ndarray]]]:
    """Order of the rows by leaf, and the nodes (from, to, first child or -1, radius, centroid); the
    second child follows the first."""
    square = np.add.reduceat(rows.data.astype(float) ** 2, rows.ptr[:-1])
    order = np.arange(len(rows))
    nodes: list = [None]
    todo = [(0, 0, len(rows), rows)]
    while todo:
        at, lo, hi, own = todo.pop()
        norm = square[order[lo:hi]]
        centre = np.bincount(own.ids, own.data.astype(float), size) / (hi - lo)
        cc = float(centre @ centre)
        far2 = np.maximum(0.0, norm - 2 * own.dot(centre) + cc)
        # squares lose less than 1e-9 of the sum of their terms: long vectors have fewer than a million entries
        radius = math.sqrt(float(far2.max()) + 1e-9 * (float(norm.max()) + cc)) if hi > lo else 0.0
        child = -1
        if hi - lo > LEAF and far2.max() > 1e-9 * (norm.max() + cc):
            a = own.dense(int(far2.argmax()), size)
            b = own.dense(int((norm - 2 * own.dot(a)).argmax()), size)
            half = np.argsort(own.dot(a - b), kind="stable")
            mid = (lo + hi) // 2
            order[lo:hi] = order[lo:hi][half]
            child = len(nodes)
            nodes += [None, None]
            todo += [(child, lo, mid, own.take(half[:mid - lo])), (child + 1, mid, hi, own.take(half[mid - lo:]))]
        nodes[at] = (lo, hi, child, radius, centre)
    return order, nodes


_TREE = ("doc_ids binary, no_id binary, ptr binary, ids binary, data binary, nodes binary, radii binary, "
         "centre_ptr binary, centre_ids binary, centre_data binary")


def _trees(batches: Iterator[pa.RecordBatch], weights: np.ndarray, rows: int, length: int) -> Iterator[pa.RecordBatch]:
    """Vectors -> one row a block: its documents in leaf order and its nodes."""
    names = [x.split()[0] for x in _TREE.split(", ")]

    def tree(held: list) -> pa.RecordBatch:
        ptr = np.append(0, np.cumsum([len(h[1]) for h in held]))
        vectors = Rows(ptr, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        order, nodes = grow(vectors, len(weights))
        vectors = vectors.take(order)
        docs = [held[i][0] for i in order]
        centres = [np.flatnonzero(n[4]) for n in nodes]
        arrays = [np.array([0 if d is None else d for d in docs], "<i8"), np.array([d is None for d in docs], bool),
                  vectors.ptr.astype("<i8"), vectors.ids.astype("<i4"), vectors.data.astype("<i8"),
                  np.array([n[:3] for n in nodes], "<i4"), np.array([n[3] for n in nodes], "<f8"),
                  np.append(0, np.cumsum([len(c) for c in centres])).astype("<i8"), np.concatenate(centres).astype("<i4"),
                  np.concatenate([n[4][c] for n, c in zip(nodes, centres)]).astype("<f8")]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)

    held, entries = [], 0
    for b in batches:
        for doc, n, ids, tfs in zip(*(b.column(k).to_pylist() for k in range(4))):
            ids = np.frombuffer(ids, "<i4")
            data = weights[ids] * saturated(np.frombuffer(tfs, "<i8"), n, rows, length)
            ids, data = ids[data > 0], data[data > 0]
            if len(ids):  # others can score nothing
                held.append((doc, ids, data))
                entries += len(ids)
            if len(held) == BLOCK or entries > BLOCK_ENTRIES:
                yield tree(held)
                held, entries = [], 0
    if held:
        yield tree(held)


class Best:
    """The k best (score, document) of each item so far; equal scores by ascending id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.full((items, k), _NEVER, np.int64)
        self.doc = np.zeros((items, k), np.int64)
        self.none = np.ones((items, k), bool)

    def floor(self) -> np.ndarray:
        """The least score that can still matter."""
        return np.maximum(1, self.score[:, -1])

    def add(self, items: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """``score`` of some documents for some items."""
        useful = (score >= self.floor()[items][:, None]).any(1)
        items = items[useful]
        if not len(items):
            return
        score = np.concatenate([self.score[items], score[useful]], 1)
        doc = np.concatenate([self.doc[items], np.broadcast_to(doc, (len(items), len(doc)))], 1)
        none = np.concatenate([self.none[items], np.broadcast_to(none, (len(items), len(none)))], 1)
        order = np.lexsort((doc, none, -score), axis=1)[:, :self.k]
        for own, new in ((self.score, score), (self.doc, doc), (self.none, none)):
            own[items] = np.take_along_axis(new, order, 1)


def visit(tree: dict, best: Best, ptr: np.ndarray, ids: np.ndarray, size: int) -> int:
    """Best-first search of one tree for all items (``ids[ptr[i]:ptr[i + 1]]``); leaves opened."""
    doc_ids, none = np.frombuffer(tree["doc_ids"], "<i8"), np.frombuffer(tree["no_id"], bool)
    rows = Rows(np.frombuffer(tree["ptr"], "<i8"), np.frombuffer(tree["ids"], "<i4"), np.frombuffer(tree["data"], "<i8"))
    nodes, radii = np.frombuffer(tree["nodes"], "<i4").reshape(-1, 3), np.frombuffer(tree["radii"], "<f8")
    centres = Rows(*(np.frombuffer(tree[c], t) for c, t in (("centre_ptr", "<i8"), ("centre_ids", "<i4"), ("centre_data", "<f8"))))
    norms = np.sqrt(np.diff(ptr)) * (1 + 1e-12)

    def bound(node: int) -> np.ndarray:
        near = np.add.reduceat(centres.dense(node, size)[ids], ptr[:-1])
        return (near + radii[node] * norms) * (1 + 1e-9) + 1

    opened, heap = 0, []
    first = bound(0)
    heapq.heappush(heap, (-float(first.max()), 0, first))
    while heap:
        _, node, most = heapq.heappop(heap)
        needed = most >= best.floor()
        if not needed.any():
            continue
        lo, hi, child = nodes[node].tolist()
        if child >= 0:
            for c in (child, child + 1):
                own = bound(c)
                live = own >= best.floor()
                if live.any():
                    heapq.heappush(heap, (-float(own[live].max()), c, own))
            continue
        opened += 1
        leaf = np.zeros((size, hi - lo), np.int64)
        own = slice(rows.ptr[lo], rows.ptr[hi])
        leaf[rows.ids[own], np.repeat(np.arange(hi - lo), np.diff(rows.ptr[lo:hi + 1]))] = rows.data[own]
        items = np.flatnonzero(needed)
        n = np.diff(ptr)[items]
        begin = np.append(0, np.cumsum(n))
        at = np.arange(begin[-1]) + np.repeat(ptr[items] - begin[:-1], n)
        best.add(items, np.add.reduceat(leaf[ids[at]], begin[:-1], axis=0), doc_ids[lo:hi], none[lo:hi])
    return opened


def _search(batches: Iterator[pa.RecordBatch], ptr: np.ndarray, ids: np.ndarray, size: int, k: int) -> Iterator[pa.RecordBatch]:
    best = Best(len(ptr) - 1, k)
    for b in batches:
        for i in range(b.num_rows):
            visit({name: b.column(j)[i].as_buffer() for j, name in enumerate(b.schema.names)}, best, ptr, ids, size)
    item, place = np.nonzero(best.score > 0)
    doc = pa.array(best.doc[item, place], mask=best.none[item, place])
    yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), doc, pa.array(best.score[item, place])], names=["item", "doc_id", "score"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [sorted(set(terms(t.as_buffer().to_pybytes()))) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.binary()))], names=["item_id", "terms"])


def build_trees(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[DataFrame, np.ndarray] | None:
    """The written trees of ``docs`` (doc_id, text) over the terms of ``vocabulary``, and the terms'
    weights; None if no document holds any of them."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    vectors = written(texts.mapInArrow(lambda b: _vectors(b, vocabulary), _VECTORS), "ball-vectors")
    sums = vectors.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()  # one row a term
    sums = {r["doc_id"]: r["n"] for r in sums}
    rows, length = sums.get(-1, 0), sums.get(-2, 0)
    if not any(t >= 0 for t in sums):
        return None
    weights = np.array([weight(rows, sums.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    trees = vectors.where("kind = 0").select("doc_id", "n", "ids", "tfs").mapInArrow(lambda b: _trees(b, weights, rows, length), _TREE)
    return written(trees, "ball-trees"), weights


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, together: int = TOGETHER) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item.

    ``docs`` has doc_id (long) and text, ``items`` item_id (long) and text. Every row of ``docs`` is a
    document of its own, also when rows repeat or share an id; documents without an id rank last
    among equal scores. Rows of ``items`` that share an item_id (or have none) are one item with the
    terms of all. Null texts have no terms; items without any, or that no document shares a term
    with, have no rows, nor do scores of 0. Other columns are ignored; empty tables give no rows.
    Memory of a task: one tree, and ``together`` times ``k`` results.
    """
    spark = docs.sparkSession
    prepare(spark)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text")).mapInArrow(
        _item_terms, "item_id long, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()
    asked = written(asked.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")), "ball-items")
    blocks = -(-asked.count() // together)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = sorted(own.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0))  # about ``together`` items
        if not rows:
            continue
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        built = build_trees(docs, vocabulary)
        if built is None:
            continue
        trees, weights = built
        ids = np.array([vocabulary[bytes(t)] for r in rows for t in r["terms"]], np.int64)
        ptr = np.append(0, np.cumsum([len(r["terms"]) for r in rows]))
        found = trees.mapInArrow(lambda b, p=ptr, i=ids, n=len(weights): _search(b, p, i, n, k), "item int, doc_id long, score long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        out = out.union(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
