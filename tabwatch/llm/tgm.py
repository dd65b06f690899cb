"""Jaccard join of word n-gram sets through a token-group matrix.

A document's set holds 64-bit hashes of its distinct n-grams. Documents with equal sets are one
class. Then:

1. Tokens: each class gives the tokens of its prefix in a global order (tokens of crowded buckets
   of a count sketch over all documents last, then by hash). A pair of linked sets shares at least
   c(n) of them, c(n) = 1 + n * EXTRA // 100 for the smaller size n; classes that share fewer with
   all others together hold no link and are done. The sets of the others alone are written, one a
   class; their tokens are counted exactly, and the prefixes taken anew with the tokens of more than
   HEAVY classes after all others, in steps (before the crowded ones), so that a passage that many
   texts share does not pair them. Any order that is the same for all sets is right.
2. Groups: every token has a centre, the class of smallest hash among those that hold it. A class is
   compared with the centre that most of its tokens name; linked ones become one group, so that a
   cluster of near copies is a group from here on and not a pair for every two of its members.
3. Matrix: one row for each (token, group) with the range of set sizes, the group's token union.
   Two groups that share fewer than c(n) tokens of their unions, or whose sizes don't fit, hold no
   link. For the others, the one with fewer members is the query: its sets are sent to the other
   group, which is opened: exact intersections, and the pair is closed at its first link.
4. The matrix is opened twice: first every token pairs its groups with the largest of them only;
   what links is merged and the matrix keyed anew by the merged groups; then all pairs that are
   left are opened. The last matrix has the prefixes for one shared token alone (c = 1): a variant
   of a text that isn't linked with it holds as many tokens beside the text's as it indexes, so
   that many variants, each just too far from the text, don't pair each other over the text's tokens.

Prefix lengths: with sizes n <= m and overlap >= t/(1+t) (n+m), the first n - ceil(2t/(1+t) n) +
c(n) tokens of the smaller and m - ceil(t m) + c(m) of the larger set share at least c(n).
Links decide the components; pairs inside a component are not all compared and never listed.
Sets are equal if their sizes and two 64-bit sums over them are; n-grams if their hashes are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import connected_components, gives_back, prepare, tasks, utf8, written

#: Buckets of the count sketch (two bytes each a task, one bit each when broadcast), in slices.
SKETCH_BITS = 21
SLICES = 16
EXTRA = 4
#: Tokens of the members that one task indexes, and members that one task compares with a centre.
PART_TOKENS = 4_000_000
PART_MEMBERS = 2000
#: Bits of the filter that spares documents of no group; it only ever lets more through.
FILTER_BITS = 23
_U = np.uint64
_SET = "kind int, doc_id long, n long, c long, t binary, slice int, packed binary"
_TOKENS = "token long, c long, n int, indexed boolean, first int"
#: Classes that may hold a token before it is moved towards the end of the order, step by step.
HEAVY = (8, 64, 512, 4096)
#: Hashes in a batch that leaves a worker (one set more at most).
BATCH_HASHES = 1 << 19
#: Sets that a task remembers having written.
REMEMBERED = 1 << 19


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer (shifts and odd multipliers), one permutation for each seed."""
    x = x ^ _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word n-grams of a text (A-Z lower-cased, words parted by
    ASCII white space); with fewer words the whole sequence is one; without words none."""
    words = text.lower().split()
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(ids):
        return ids
    k = min(k, len(ids))
    out = np.full(len(ids) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _U(0x9E3779B97F4A7C15) + ids[i:len(ids) - k + 1 + i]
    return np.unique(_mix(out))


def _sum(x: np.ndarray) -> int:
    return int(x.sum(dtype=np.uint64).astype(np.int64)) if len(x) else 0


def describe(s: np.ndarray) -> tuple[int, int, int]:
    """Size and two sums of a set."""
    return len(s), _sum(_mix(s, 0x2545F4914F6CDD1D)), _sum(_mix(s, 0x369DEA0F31A53F85))


def class_of(own: tuple[int, int, int]) -> int:
    """The class of a set, from its description."""
    return int.from_bytes(xxhash.xxh3_64_digest(struct.pack("<3q", *own)), "little", signed=True)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


@gives_back
def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    names = ["kind", "doc_id", "n", "c", "t", "slice", "packed"]
    types = [pa.int32(), *[pa.int64()] * 3, pa.binary(), pa.int32(), pa.binary()]
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for b in batches:
        rows = []
        for doc, text, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            s = shingle_set(text.as_buffer().to_pybytes(), k)
            np.add.at(counts, (s >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
            rows.append((0, doc, len(s), class_of(describe(s)) if doc is not None and len(s) else None, t, None, None))
        yield _batch(rows, names, types)
    if counts.any():
        for i, part in enumerate(np.split(np.minimum(counts, 65535).astype("<u2"), SLICES)):
            yield _batch([(1, None, 0, None, None, i, part.tobytes())], names, types)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Rows (text) -> lists of (c, set), bounded; copies in a task come once."""
    seen: set[int] = set()
    for b in batches:
        sets, held = [], 0
        for text in b.column(0):
            s = shingle_set(text.as_buffer().to_pybytes(), k)
            c = class_of(describe(s))
            if not len(s) or c in seen:
                continue
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.add(c)
            sets.append((c, s))
            held += len(s)
            if held > BATCH_HASHES:
                yield sets
                sets, held = [], 0
        if sets:
            yield sets


@gives_back
def _packed(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) whose key is in the filter -> their sets, in one worker: a second one a task would
    stay with the executor, and later steps would fill it too."""
    for sets in _sets((b.select(["text"]) for b in _through(batches, bits)), k):
        yield _batch([(c, len(s), s.tobytes()) for c, s in sets], ["c", "n", "packed"], [pa.int64(), pa.int64(), pa.binary()])


@gives_back
def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw.as_buffer(), np.int64))], names=["key"])


@gives_back
def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of the buckets far above the mean of their slice; rows come sorted by slice."""
    at, total = None, None

    def bits() -> pa.RecordBatch:
        mean = total.mean()
        return _batch([(at, np.packbits(total > mean + 6 * np.sqrt(mean) + 16).tobytes())], ["slice", "bits"], [pa.int32(), pa.binary()])

    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != at:
                if at is not None:
                    yield bits()
                at, total = k, np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
            total += np.frombuffer(raw, "<u2")
    if at is not None:
        yield bits()


def extra(n: int) -> int:
    return 1 + n * EXTRA // 100


def lengths(n: int, percent: int, c: int) -> tuple[int, int]:
    """Tokens of the probing and of the indexing prefix of a set of n, so that linked sets share c of them."""
    return min(n, n + (-percent * n // 100) + c), min(n, n + (-2 * percent * n // (100 + percent)) + c)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (unsigned) are in a bitmap over leading bits."""
    lead = keys >> _U(64 - FILTER_BITS)
    return (bits[(lead >> _U(3)).astype(np.int64)] & (128 >> (lead & _U(7)).astype(np.int64))) > 0


def prefix(s: np.ndarray, crowded: np.ndarray, percent: int, heavy: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, int]:
    """The tokens of the (longer) probing prefix in the global order (those in more of the bitmaps
    ``heavy`` later, the crowded ones last), and how many of them the indexing prefix has."""
    n = len(s)
    late = crowded[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    probe, index = lengths(n, percent, extra(n))
    place = np.where(late, len(heavy) + 1, sum((_marked(bits, s).astype(np.int8) for bits in heavy), np.zeros(n, np.int8)))
    return s[np.argsort(place, kind="stable")[:probe]], index


def _prefixes(sets: list[tuple[int, np.ndarray]], crowded: np.ndarray, percent: int, heavy: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Prefix tokens; indexed: in the indexing prefix for c(n) shared tokens; first: 1 in the probing, 2 also in
    the indexing prefix for one shared token, 0 in neither."""
    cut = [prefix(s, crowded, percent, heavy) for _, s in sets]
    each = [len(own) for own, _ in cut]
    one = [lengths(len(s), percent, 1) for _, s in sets]
    first = [(np.arange(n) < probe).astype(np.int32) + (np.arange(n) < index) for n, (probe, index) in zip(each, one)]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([own for own, _ in cut]).view(np.int64)),
        pa.array(np.repeat(np.array([c for c, _ in sets], np.int64), each)),
        pa.array(np.repeat(np.array([len(s) for _, s in sets], np.int32), each)),
        pa.array(np.concatenate([np.arange(len(own)) < short for own, short in cut])),
        pa.array(np.concatenate(first))], names=["token", "c", "n", "indexed", "first"])


@gives_back
def _first_tokens(batches: Iterator[pa.RecordBatch], k: int, crowded: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (text) -> the prefix tokens of their sets."""
    for sets in _sets(batches, k):
        yield _prefixes(sets, crowded, percent, ())


@gives_back
def _matrix(batches: Iterator[pa.RecordBatch], crowded: np.ndarray, percent: int, heavy: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    """Rows (c, packed) -> their prefix tokens."""
    for b in batches:
        sets, held = [], 0
        for c, raw in zip(b.column(0).to_pylist(), b.column(1)):
            sets.append((c, np.frombuffer(raw.as_buffer(), np.uint64)))
            held += len(sets[-1][1])
            if held > BATCH_HASHES:
                yield _prefixes(sets, crowded, percent, heavy)
                sets, held = [], 0
        if sets:
            yield _prefixes(sets, crowded, percent, heavy)


def _through(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose first column, a hash, is in the filter."""
    for b in batches:
        yield b.filter(pa.array(_marked(bits, b.column(0).to_numpy().view(np.uint64))))


@gives_back
def _let_through(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _through(batches, bits)


class _Members:
    """An inverted index of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens = tokens[order]
        del tokens
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]

    def near(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Which members are linked with ``s``."""
        lo, hi = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= percent * (self.sizes + len(s) - both))


_EDGE = (["a", "b"], [pa.int64(), pa.int64()])


@gives_back
def _opened(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, role, comp, tokens) sorted by part and role: members, then queries -> edges."""
    at, group, sets, index, closed = None, None, [], None, set()
    for b in batches:
        edges = []
        for part, role, comp, raw in zip(*(b.column(k).to_pylist() for k in range(4))):
            if part != at:
                at, sets, index, closed = part, [], None, set()
            if role == 0:
                group = comp
                sets.append(np.frombuffer(raw, np.uint64))
                continue
            if comp in closed or not (sets or index):
                continue
            if index is None:  # which holds all that the sets hold
                index, sets = _Members(sets), []
            if len(index.near(np.frombuffer(raw, np.uint64), percent)):
                closed.add(comp)
                edges.append((group, comp))
        yield _batch(edges, *_EDGE)


def _filter(keys: DataFrame) -> np.ndarray:
    """A bitmap over the leading bits of a column of hashes; FILTER_BITS bits whatever the data."""
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    lead = f"shiftrightunsigned(key, {64 - FILTER_BITS})"
    words = keys.select(F.expr(f"cast(shiftright({lead}, 3) as int)").alias("byte"),
                        F.expr(f"shiftright(128, cast({lead} & 7 as int))").alias("bit"))
    for r in words.groupBy("byte").agg(F.bit_or("bit").alias("bits")).coalesce(4).toLocalIterator():  # a job a partition
        bits[r["byte"]] = r["bits"]
    return bits


def _least(n) -> F.Column:
    """c(n): tokens that linked sets share at least, n the smaller size."""
    return 1 + F.floor(n * EXTRA / 100)


def _fits(least, most, least_indexed, most_indexed, percent: int) -> F.Column:
    """Can sets of the sizes least..most be linked with no larger ones of the sizes least_indexed..most_indexed?"""
    return (F.col(least_indexed) <= F.col(most)) & (100 * F.col(most_indexed) >= percent * F.col(least))


def _several(tokens: DataFrame) -> DataFrame:
    """``tokens`` (token, c, ...) without those of one class alone."""
    same = Window.partitionBy("token")
    return tokens.withColumn("lo", F.min("c").over(same)).withColumn("hi", F.max("c").over(same)).where("lo < hi").drop("lo", "hi")


def _with_centres(shared: DataFrame, sets: DataFrame, percent: int, spark) -> DataFrame:
    """Edges between classes and the centre that most of their tokens name, where they are linked."""
    centres = shared.groupBy("token").agg(F.min_by(F.struct("c", "n"), F.xxhash64("c")).alias("centre"))
    named = shared.select("token", "c", "n").join(centres, "token").where("c <> centre.c")
    small, large = F.least("n", "centre.n"), F.greatest("n", "centre.n")
    named = named.where(100 * small >= percent * large).groupBy("c", "n", "centre").agg(F.count("*").alias("tokens"))
    # half of what a linked pair shares: other centres may have taken some of its tokens
    named = named.where(2 * F.col("tokens") >= _least(F.least("n", "centre.n")))
    pairs = written(named.groupBy("c").agg(F.max_by("centre.c", F.struct("tokens", "centre.c")).alias("centre")), "tgm-centres")
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PART_MEMBERS).alias("parts"))
    pairs = pairs.join(parts, "centre").withColumn("part", F.xxhash64("centre", F.pmod(F.xxhash64("c"), "parts")))
    held = pairs.select("part", F.col("centre").alias("c")).distinct().select("part", F.lit(0).alias("role"), F.col("c").alias("comp"), "c")
    asked = pairs.select("part", F.lit(1).alias("role"), F.col("c").alias("comp"), "c")
    return _compared(held.union(asked), sets, percent, spark)


def _compared(routes: DataFrame, sets: DataFrame, percent: int, spark) -> DataFrame:
    """Routes (part, role, comp, c): in each part the sets of members (role 0) are compared with those of
    queries (role 1). A filter spares the shuffle of sets that no route names."""
    routes = written(routes, "tgm-routes")
    bits = _filter(routes.select(F.col("c").alias("key")))
    near = sets.mapInArrow(lambda b: _let_through(b, bits), "c long, tokens binary")
    rows = routes.join(near, "c").select("part", "role", "comp", "tokens")
    return rows.repartition(2 * tasks(spark), "part").sortWithinPartitions("part", "role", "comp").mapInArrow(
        lambda b: _opened(b, percent), "a long, b long")


def _matrix_of(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each token and group: the sizes of the sets that hold it, and of those that index it (``indexed``)."""
    short = F.when(F.col("indexed"), F.col("n"))
    return written(shared.join(groups.select("c", "comp"), "c").groupBy("token", "comp").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min(short).alias("least_indexed"), F.max(short).alias("most_indexed")), "tgm-matrix")


def _open(pairs: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, spark) -> DataFrame:
    """Edges between the groups of ``pairs`` (x, y) that hold a link: the smaller is the query."""
    held = groups.groupBy("comp").agg(F.count("*").alias("members"), F.ceil(F.sum("n") / PART_TOKENS).cast("int").alias("parts"))
    x, y = (held.select(F.col("comp").alias(c), F.col("members").alias(f"members_{c}"), F.col("parts").alias(f"parts_{c}")) for c in "xy")
    sized = pairs.join(x, "x").join(y, "y")
    more = F.col("members_x") >= F.col("members_y")
    plan = written(sized.select(F.when(more, F.col("x")).otherwise(F.col("y")).alias("opened"),
                                F.when(more, F.col("y")).otherwise(F.col("x")).alias("query"),
                                F.when(more, F.col("parts_x")).otherwise(F.col("parts_y")).alias("parts")), "tgm-plan")
    parts = plan.groupBy("opened").agg(F.max("parts").alias("parts"))
    member = groups.join(parts, F.col("comp") == F.col("opened")).select(
        F.xxhash64("opened", F.pmod("c", "parts")).alias("part"), F.lit(0).alias("role"), "comp", "c")
    asked = groups.join(plan, F.col("comp") == F.col("query")).withColumn(
        "p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select(
        F.xxhash64("opened", "p").alias("part"), F.lit(1).alias("role"), "comp", "c")
    return _compared(member.union(asked), sets, percent, spark)


def _merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (c, n, comp) where a comp takes the name of the group that it is linked with (a: the
    centre or larger group, b). Two steps up are enough to gather a cluster; components come at the end."""
    up = written(edges.groupBy(F.col("b").alias("comp")).agg(F.min("a").alias("up")), "tgm-up")
    twice = up.join(up.select(F.col("comp").alias("up"), F.col("up").alias("top")), "up", "left").select("comp", F.coalesce("top", "up").alias("up"))
    out = groups.join(twice, "comp", "left")
    return written(out.select("c", "n", F.coalesce("up", "comp").alias("comp")), "tgm-groups")


def linked_rows(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (doc_id, n, c, t): size and class of their sets (c null for rows
    without a set or an id), t the md5 of the text; and (c, n, comp) of every class: linked classes
    have the same comp, any of their c."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    described = written(texts.withColumn("t", F.unhex(F.md5("text"))).mapInArrow(lambda b: _describe(b, k), _SET), "tgm-rows")
    rows = described.where("kind = 0").select("doc_id", "n", "c", "t")
    classes = written(rows.where("c is not null").groupBy("c").agg(F.min("n").alias("n")), "tgm-classes")

    # 1. tokens that classes share, in prefixes by the sketch: which classes may hold a link
    crowded = np.zeros(1 << SKETCH_BITS, bool)
    sketch = described.where("kind = 1").select("slice", "packed").repartition(SLICES, "slice").sortWithinPartitions("slice")
    for r in sketch.mapInArrow(_crowded, "slice int, bits binary").collect():  # SLICES rows
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
        crowded[r["slice"] * len(own):(r["slice"] + 1) * len(own)] = own
    first = texts.where("doc_id is not null").select("text").mapInArrow(lambda b: _first_tokens(b, k, crowded, percent), _TOKENS)
    # copies from several tasks fall away where their token lies
    held = _several(first).select("token", "c", "n").distinct().groupBy("c", "n").agg(F.count("*").alias("held"))
    able = written(held.where(F.col("held") >= _least(F.ceil(percent * F.col("n") / 100))).select("c"), "tgm-able")
    # one set of each, from a text of each
    one = rows.join(able, "c").groupBy("c").agg(F.min("t").alias("t"))
    bits = _filter(one.select(F.xxhash64("t").alias("key")))
    near = texts.where("doc_id is not null").select(F.xxhash64(F.unhex(F.md5("text"))).alias("key"), "text")
    sets = near.mapInArrow(lambda b: _packed(b, k, bits), "c long, n long, packed binary")
    sets = written(sets.join(able, "c", "left_semi").dropDuplicates(["c"]), "tgm-sets")
    # prefixes anew, by the exact number of classes that hold a token
    often = sets.select("packed").mapInArrow(_all_tokens, "key long").groupBy("key").agg(F.count("*").alias("classes"))
    often = written(often.where(F.col("classes") > HEAVY[0]), "tgm-heavy")
    heavy = tuple(_filter(often.where(F.col("classes") > many)) for many in HEAVY)
    tokens = _several(sets.select("c", "packed").mapInArrow(lambda b: _matrix(b, crowded, percent, heavy), _TOKENS))
    held = tokens.withColumn("held", F.count("*").over(Window.partitionBy("c")))
    shared = written(held.where(F.col("held") >= _least(F.ceil(percent * F.col("n") / 100))).drop("held"), "tgm-shared")
    sets = sets.select("c", F.col("packed").alias("tokens"))

    # 2. groups about centres
    groups = written(shared.select("c", "n", F.col("c").alias("comp")).distinct(), "tgm-groups")
    edges = written(_with_centres(shared, sets, percent, spark), "tgm-edges")
    groups = _merged(groups, edges)

    # 3. and 4.: every group against the largest that shares a token, then all pairs that are left
    for last in (False, True):
        # one token is enough at the end: what isn't linked with the text that it varies has so many tokens of
        # its own that it indexes no other, so that such variants don't pair each other
        matrix = _matrix_of(shared.where("first > 0").withColumn("indexed", F.col("first") == 2) if last else shared, groups)
        query = matrix.select("token", F.col("comp").alias("query"), "least", "most")
        if last:
            group = matrix.where("least_indexed is not null").select("token", F.col("comp").alias("opened"), "least_indexed", "most_indexed")
        else:
            members = groups.groupBy("comp").agg(F.count("*").alias("members"))
            best = F.max_by(F.struct("comp", "least", "most"), F.struct("members", "comp"))
            group = matrix.join(members.where("members > 1"), "comp").groupBy("token").agg(best.alias("g")).select(
                "token", F.col("g.comp").alias("opened"), F.col("g.least").alias("least_indexed"), F.col("g.most").alias("most_indexed"))
        fits = (F.col("query") != F.col("opened")) & (_fits("least", "most", "least_indexed", "most_indexed", percent)
                                                      if last else (100 * F.col("most_indexed") >= percent * F.col("least")))
        pairs = query.join(group, "token").where(fits).groupBy("query", "opened").agg(
            F.count("*").alias("shared"), F.min(F.least("least_indexed", "least")).alias("smallest"))
        pairs = pairs if last else pairs.where(F.col("shared") >= _least(F.col("smallest")))
        pairs = written(pairs.select(F.least("query", "opened").alias("x"), F.greatest("query", "opened").alias("y")).distinct(), "tgm-pairs")
        found = written(_open(pairs, groups, sets, percent, spark), "tgm-edges")
        edges = edges.union(found)  # a group's name is a class that earlier edges link with its members
        groups = groups if last else _merged(groups, found)
    whole = connected_components(edges).withColumnRenamed("node", "c")
    linked = classes.join(whole, "c", "left").select("c", "n", F.coalesce("component", "c").alias("comp"))
    return rows, written(linked, "tgm-linked")


def jaccard_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id long, text string).

    Two documents link when 100 * intersection >= percent * union of their k-word n-gram sets.
    Null, empty and blank texts have empty sets and link with nothing; a text of fewer than k
    words has one n-gram. Rows with a null id have a null component and link with nothing. Rows
    that repeat, or share an id, stay rows; rows that share an id share a component, also through
    their other rows. Other columns are ignored; an empty table gives no rows.
    """
    rows, linked = linked_rows(docs, k, percent)
    own = rows.where("c is not null").select("doc_id", "c").join(linked.select("c", "comp"), "c")
    ids = written(own.select("doc_id", "comp").distinct(), "tgm-ids")
    # an id with rows in several components joins them
    several = ids.groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).where("a < z").select("doc_id", "a")
    if several.take(1):
        ids = _joined(ids, several)
    named = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(named, "comp").select("doc_id", "component_id").distinct()
    return rows.join(named, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(ids: DataFrame, several: DataFrame) -> DataFrame:
    """``ids`` (doc_id, comp) with the components that an id of ``several`` lies in as one."""
    joined = connected_components(ids.join(several, "doc_id").where("a <> comp").select("a", F.col("comp").alias("b")))
    return ids.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("doc_id", F.coalesce("component", "comp").alias("comp"))


def one_of_each(docs: DataFrame, k: int, percent: int, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component of linked sets.

    The one with the smallest doc_id stays (then the smallest text hash, then the smallest values of
    ``columns``). Rows decide, not ids: rows that share an id but no component all stay, as do rows
    without an id or without words.
    """
    rows, linked = linked_rows(docs, k, percent)
    own = rows.where("c is not null").select("doc_id", "c", "t").join(linked.select("c", "comp"), "c")
    first = own.groupBy("comp").agg(F.min(F.struct("doc_id", "t")).alias("first"))
    stays = written(first.select("first.*"), "tgm-first")
    gone = written(own.select("doc_id", "t").distinct().join(stays, ["doc_id", "t"], "left_anti"), "tgm-gone")
    keyed = docs.select(*columns, F.unhex(F.md5(utf8("text"))).alias("t_"))
    gone = gone.select(F.col("doc_id").alias("d_"), "t")
    kept = keyed.join(gone, (F.col("doc_id") == F.col("d_")) & (F.col("t_") == F.col("t")), "left_anti")
    # rows that repeat their id and text are copies of each other
    again = own.groupBy("doc_id", "t").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("d_"), "t")
    again = written(again, "tgm-again")
    if not again.take(1):
        return kept.select(*columns)
    same = (F.col("doc_id") == F.col("d_")) & (F.col("t_") == F.col("t"))
    one = kept.join(again, same, "left_semi").groupBy("doc_id", "t_").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return kept.join(again, same, "left_anti").select(*columns).union(one.select(*columns))
