"""Exact cosine range join of vectors, in blocks that meet where they are read.

On unit vectors, cosine >= t is distance <= eps = sqrt(2 - 2t). Equal vectors are one point with
a count (a class). Points are ordered by their nearest pivot and the distance to it and packed into
blocks, one row of a written table each, with a centre and a radius. Two blocks can hold a link
only if their centres are no further apart than both radii and eps; such blocks meet once, in a
cartesian join: a task reads some blocks and streams others past them, so no vector is written
again for the blocks that it meets and disk and memory do not depend on the pairs. Where the
triangle inequality prunes little (many dimensions) the work is that of all pairs of points.

A pair of blocks is first screened by some of the dimensions: x y <= x' y' + |x''| |y''| for the
first half ' and the rest '' of a vector. Screens are in single precision; whatever is within
``BAND`` of the limit is computed again in double precision. Tasks give counts and, for the
components, a spanning forest of the points that they have seen, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import connected_components, prepare, tasks, written

#: Points for each pivot, and the most pivots.
CELL = 8192
MOST_PIVOTS = 1024
#: Points of a block, and points that meet a block at a time.
HOMES = 4096
STREAMED = 256
#: Bins of the distance to a pivot, by which the points of a cell are ordered.
BINS = 256
#: Blocks that a task holds on either side.
MOST_HELD = 16
BAND = 1e-5
_KEYED = "vec_id long, k1 long, k2 long"
_POINTS = "dim int, k1 long, k2 long, rep long, size long, vector binary"
_BLOCK = "block long, k1 binary, k2 binary, rep binary, size binary, vectors binary, centre array<double>, radius double"
_LINKS = "k1 long, k2 long, rep long, links long, other long"
_SIDE = ("block", "k1", "k2", "rep", "size", "vectors")


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow of squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fine(ids: pa.Array, vectors: pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of the rows that can link, by length of the vector."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(kind)
    first, known = np.cumsum(lengths) - lengths, ids.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero((lengths == dim) & known)
        x = flat[first[at][:, None] + np.arange(dim)] + np.zeros(1, kind)  # -0 is 0
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        if good.any():
            yield at[good], x[good]


def _digests(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in x), "<i8").reshape(-1, 2)


def _key(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The digest of every row's vector, null where it cannot link."""
    for b in batches:
        keys, none = np.zeros((b.num_rows, 2), np.int64), np.ones(b.num_rows, bool)
        for at, x in _fine(b.column(0), b.column(1), kind):
            keys[at], none[at] = _digests(x), False
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(keys[:, k].copy(), mask=none) for k in (0, 1)]], names=["vec_id", "k1", "k2"])


def _points(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The vectors of a batch with their smallest id and their number, equal ones once."""
    names, types = [x.split()[0] for x in _POINTS.split(", ")], [pa.int32(), *[pa.int64()] * 4, pa.binary()]
    for b in batches:
        ids = pc.fill_null(b.column(0), 0).to_numpy()
        for at, x in _fine(b.column(0), b.column(1), kind):
            _, first, which, size = np.unique(keys := _digests(x), axis=0, return_index=True, return_inverse=True, return_counts=True)
            rep = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(rep, which.ravel(), ids[at])
            columns = [np.full(len(first), x.shape[1]), keys[first, 0], keys[first, 1], rep, size, [r.tobytes() for r in x[first]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _smallest(batches: Iterator[pa.RecordBatch], wanted: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The points of a task with the smallest digests, as many as pivots are wanted of each length."""
    held: dict[int, dict[tuple[int, int], bytes]] = {}
    for b in batches:
        for dim, k1, k2, vector in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 5))):
            own = held.setdefault(dim, {})
            own[k1, k2] = vector
            if len(own) >= 2 * wanted[dim] + 1000:
                held[dim] = dict(sorted(own.items())[:wanted[dim]])
    rows = [(dim, *key, v) for dim, own in held.items() for key, v in sorted(own.items())[:wanted[dim]]]
    columns = list(zip(*rows)) if rows else [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                                     names=["dim", "k1", "k2", "vector"])


def _merged(batches: Iterator[pa.RecordBatch], kind: str, pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Points sorted by digest -> each once, with its place (cell of the nearest pivot, bin of the distance)."""
    names = ["place", *[x.split()[0] for x in _POINTS.split(", ")]]
    first, cells = {}, 0
    for dim in sorted(pivots):
        first[dim], cells = cells, cells + len(pivots[dim])

    def placed(rows: list[list]) -> pa.RecordBatch:
        dims, place = np.array([r[0] for r in rows]), np.zeros(len(rows), np.int64)
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            unit = _unit(np.frombuffer(b"".join(rows[i][5] for i in at.tolist()), kind).reshape(-1, dim))
            d = np.sqrt(np.maximum(0.0, 2 - 2 * unit @ pivots[dim].T))
            home = d.argmin(1)
            near = np.minimum(BINS - 1, d[np.arange(len(d)), home] / 2 * BINS).astype(np.int64)
            place[at] = (first[dim] + home) * BINS + near
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(place), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:5]],
                                           pa.array(columns[5], pa.binary())], names=names)

    rows: list[list] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and rows[-1][1:3] == list(row[1:3]):
                rows[-1][3], rows[-1][4] = min(rows[-1][3], row[3]), rows[-1][4] + row[4]
                continue
            if len(rows) >= 2048:
                yield placed(rows)
                rows = []
            rows.append(list(row))
    if rows:
        yield placed(rows)


def _pack(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Points sorted by place -> blocks of ``HOMES`` points, or half as many where a cell ends."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    begin, blocks, rows, last = TaskContext.get().partitionId() << 32, 0, [], None

    def packed() -> pa.RecordBatch:
        columns = list(zip(*rows))
        raw = b"".join(columns[4])
        unit = _unit(np.frombuffer(raw, kind).reshape(len(rows), -1))
        centre = unit.mean(0)
        radius = float(np.sqrt(((unit - centre) ** 2).sum(1).max())) + 1e-6
        arrays = [pa.array([np.array(c, "<i8").tobytes()], pa.binary()) for c in columns[:4]]
        return pa.RecordBatch.from_arrays([pa.array([begin + blocks]), *arrays, pa.array([raw], pa.binary()),
                                           pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])], names=names)

    for b in batches:
        for place, dim, *row in zip(*(c.to_pylist() for c in b.columns)):
            cell = (place // BINS, dim)
            if rows and (len(rows) == HOMES or cell[1] != last[1] or cell != last and 2 * len(rows) >= HOMES):
                yield packed()
                blocks, rows = blocks + 1, []
            rows.append(row)
            last = cell
    if rows:
        yield packed()


class _Side:
    """The points of one block."""

    def __init__(self, block: int, k1: bytes, k2: bytes, rep: bytes, size: bytes, vectors: bytes, kind: str):
        self.block = block
        self.k1, self.k2, self.rep, self.size = (np.frombuffer(x, "<i8") for x in (k1, k2, rep, size))
        self.raw = np.frombuffer(vectors, kind).reshape(len(self.rep), -1)
        unit = _unit(self.raw)
        self.single = self.screen = unit.astype(np.float32)
        if (half := unit.shape[1] // 2) >= 8:
            rest = np.sqrt((unit[:, half - 1:] ** 2).sum(1))
            self.screen = np.concatenate([self.single[:, :half - 1], rest[:, None].astype(np.float32)], 1)


class _Tile:
    """Room for the products of ``HOMES`` and ``STREAMED`` points, kept by a task."""

    def __init__(self) -> None:
        self.near, self.flags = np.empty(HOMES * STREAMED, np.float32), np.empty(HOMES * STREAMED, bool)

    def fill(self, x: np.ndarray, y: np.ndarray, least: np.float32) -> tuple[np.ndarray, np.ndarray]:
        shape = len(x), len(y)
        near, flags = (r[:shape[0] * shape[1]].reshape(shape) for r in (self.near, self.flags))
        np.matmul(x, y.T, out=near)
        return near, np.greater_equal(near, least, out=flags)


def _linked(a: _Side, b: _Side, t: float, tile: _Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in a, places in b) of the pairs with cosine >= t, tile by tile; a point of a block that
    meets itself is linked with itself."""
    least = np.float32(t - BAND)
    halves = a.screen is not a.single
    for at in range(0, len(b.rep), STREAMED):
        part = slice(at, at + STREAMED)
        if halves:
            _, maybe = tile.fill(a.screen, b.screen[part], least)
            n = np.count_nonzero(maybe)
            if not n:
                continue
            halves = n <= maybe.size >> 6  # else the screen tells little: this pair of blocks goes on without
        if halves:
            i, j = np.nonzero(maybe)
            value = np.full(len(i), t)  # all are computed below
        else:
            near, maybe = tile.fill(a.single, b.single[part], least)
            i, j = np.nonzero(maybe)
            value = near[i, j].astype(np.float64)
        j += at
        close = np.flatnonzero(np.abs(value - t) <= 2 * BAND)
        for lo in range(0, len(close), 65536):
            own = close[lo:lo + 65536]
            value[own] = (_unit(a.raw[i[own]]) * _unit(b.raw[j[own]])).sum(1)
        keep = value >= t
        if a.block == b.block:
            keep |= i == j
        if keep.any():
            yield i[keep], j[keep]


class _Seen:
    """The points that a task has linked: counts, and a forest over all of them."""

    def __init__(self) -> None:
        self.first: dict[int, int] = {}
        self.sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.links = self.parent = np.zeros(0, np.int64)

    def place(self, side: _Side) -> int:
        if side.block not in self.first:
            self.first[side.block] = n = len(self.parent)
            self.sides.append((side.k1, side.k2, side.rep))
            self.links = np.append(self.links, np.zeros(len(side.rep), np.int64))
            self.parent = np.append(self.parent, np.arange(n, n + len(side.rep)))
        return self.first[side.block]

    def add(self, a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> None:
        own, other = self.place(a), self.place(b)
        self.links[own:own + len(a.rep)] += np.bincount(i, weights=b.size[j], minlength=len(a.rep)).astype(np.int64)
        if a.block != b.block:
            self.links[other:other + len(b.rep)] += np.bincount(j, weights=a.size[i], minlength=len(b.rep)).astype(np.int64)
        i, j = i + own, j + other
        while True:  # roots are the least of their trees, and every point knows its root
            x, y = self.parent[i], self.parent[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while ((up := self.parent[self.parent]) != self.parent).any():
                self.parent = up

    def result(self) -> Iterator[pa.RecordBatch]:
        names, none = [x.split()[0] for x in _LINKS.split(", ")], lambda n: pa.nulls(n, pa.int64())
        if not self.sides:
            return
        k1, k2, rep = (np.concatenate(x) for x in zip(*self.sides))
        for found in np.array_split(at := np.flatnonzero(self.links), len(at) // 65536 + 1):
            yield pa.RecordBatch.from_arrays([*[pa.array(x[found]) for x in (k1, k2, rep, self.links)], none(len(found))], names=names)
        for found in np.array_split(at := np.flatnonzero(self.parent != np.arange(len(self.parent))), len(at) // 65536 + 1):
            n = len(found)
            yield pa.RecordBatch.from_arrays([none(n), none(n), pa.array(rep[found]), pa.array(np.zeros(n, np.int64)),
                                              pa.array(rep[self.parent[found]])], names=names)


def _meet(batches: Iterator[pa.RecordBatch], kind: str, t: float) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks -> counts of linked points, and a forest of their links. The copies of a point
    are linked with it in the pair of its block with itself, so that pair counts one too many."""
    seen, tile, a, held = _Seen(), _Tile(), None, {}

    def side(batch: pa.RecordBatch, k: int, s: str) -> _Side:
        return _Side(*[batch.column(f"{s}_{c}")[k].as_py() for c in _SIDE], kind)

    for batch in batches:
        for k in range(batch.num_rows):
            if a is None or a.block != batch.column("a_block")[k].as_py():
                a = side(batch, k, "a")
            block = batch.column("b_block")[k].as_py()
            b = a if a.block == block else held.get(block)
            if b is None:
                b = side(batch, k, "b")
                if len(held) < MOST_HELD:  # the same blocks come again for the next a
                    held[block] = b
            for i, j in _linked(a, b, t, tile):
                seen.add(a, b, i, j)
            if a is b:
                own = seen.place(a)
                seen.links[own:own + len(a.rep)] -= 1
    yield from seen.result()


def range_join(points: DataFrame, t: float) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``points`` (vec_id long, embedding array).

    n_links: other rows with cosine >= ``t`` (0 < t < 1); component_id: the smallest vec_id that
    links reach; kept: vec_id is that id. Vectors that are null, zero, empty or hold null or
    non-finite components, and rows with a null id, link with nothing (a null id has a null
    component and is not kept). Vectors of different lengths don't link. Rows that share an id
    stay rows; their links are those of their own vectors. Other columns are ignored. Equal vectors
    are known by 128-bit digests.
    """
    if not 0 < t < 1:
        raise ValueError("the cosine must lie between 0 and 1")
    spark = points.sparkSession
    prepare(spark)
    kind = "<f4" if dict(points.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = points.select(F.col("vec_id").cast("long").alias("vec_id"),
                         F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>").alias("embedding"))
    found = _links(rows, kind, t)
    keyed = rows.mapInArrow(lambda b: _key(b, kind), _KEYED)
    if found is not None:
        counts = found.where("links > 0").groupBy("k1", "k2", "rep").agg(F.sum("links").alias("n_links"))
        component = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
        counts = counts.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
            "k1", "k2", "n_links", F.coalesce("component", "rep").alias("component_id"))
        keyed = keyed.join(counts, ["k1", "k2"], "left")
    else:
        keyed = keyed.withColumn("n_links", F.lit(None).cast("long")).withColumn("component_id", F.lit(None).cast("long"))
    component = F.coalesce("component_id", "vec_id")
    return keyed.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(rows: DataFrame, kind: str, t: float) -> DataFrame | None:
    """k1, k2, rep, links, other: counts of the points that link, and spanning edges; None without points."""
    spark = rows.sparkSession
    eps = float(np.sqrt(2 - 2 * t)) + 1e-6
    points = rows.mapInArrow(lambda b: _points(b, kind), _POINTS)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    wanted = {dim: int(min(MOST_PIVOTS, -(-n // CELL))) for dim, n in sizes.items() if dim is not None and dim > 0}
    if not wanted:
        return None
    sample = points.mapInArrow(lambda b: _smallest(b, wanted), "dim int, k1 long, k2 long, vector binary").distinct()
    rank = F.row_number().over(Window.partitionBy("dim").orderBy("k1", "k2"))
    most = F.broadcast(spark.createDataFrame(list(wanted.items()), "dim int, wanted int"))
    found: dict[int, list[bytes]] = {}
    for r in sample.withColumn("rank", rank).join(most, "dim").where("rank <= wanted").select("dim", "vector").collect():
        found.setdefault(r["dim"], []).append(bytes(r["vector"]))
    if not found:
        return None
    pivots = {dim: _unit(np.frombuffer(b"".join(v), kind).reshape(-1, dim)) for dim, v in found.items()}

    n, parts = sum(sizes[dim] for dim in pivots), tasks(spark)
    classes = points.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(
        lambda b: _merged(b, kind, pivots), f"place long, {_POINTS}")
    packed = classes.repartitionByRange(max(1, min(parts, -(-n // HOMES))), "place", "k1", "k2").sortWithinPartitions("place", "k1", "k2").mapInArrow(
        lambda b: _pack(b, kind), _BLOCK)
    blocks = written(packed, "join-blocks")
    held = blocks.count()
    sides = max(math.ceil(held / MOST_HELD), min(held, math.ceil(math.sqrt(2 * parts))))
    one, other = ([F.col(c).alias(f"{s}_{c}") for c in (*_SIDE, "centre", "radius")] for s in "ab")
    apart = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    pairs = blocks.select(*one).coalesce(sides).join(
        blocks.select(*other).coalesce(sides).hint("shuffle_replicate_nl"),
        (F.col("a_block") <= F.col("b_block")) & (apart <= F.col("a_radius") + F.col("b_radius") + eps))
    pairs = pairs.select(*[f"{s}_{c}" for s in "ab" for c in _SIDE])
    return written(pairs.mapInArrow(lambda b: _meet(b, kind, t), _LINKS), "join-links")
