"""Exact order statistics of whole columns by bracketing: no sort, no shuffle of the rows.

1. One scan gives counts and one mergeable sketch a column; the sketch brackets every wanted rank.
2. One scan counts the rows below, inside and at both ends of each bracket, which proves it (a bracket
   that misses its rank is opened wider; one with more than ``MOST`` rows is bracketed again inside).
   A rank among the rows that equal an end has its value; columns of few values end here.
3. For the ranks left, one scan filters the rows inside, counts their distinct values and finds the ranks among those.

Every scan is a plain aggregate over the columns, the same at any size; what reaches the driver
is one sketch a column and at most two values for each wanted place.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch, and how far off its ranks are, as a share of the rows (a miss is noticed).
SKETCH = 4096
ERROR = 0.0015
MOST = 100_000
INF = float("inf")


def order_statistics(df: DataFrame, columns: dict[str, Column], wanted: Callable[[str, int, int], list[tuple[int, int]]]):
    """Values at given ranks (from 0) of each column, NULL and NaN left out.

    ``wanted`` is told a column's name, its values and its missing values, and gives pairs of ranks
    (equal or next to each other). Returns {name: {rank: value}}, {name: (values, missing)}.
    """
    names = list(columns)
    base = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"c{i}") for i, c in enumerate(columns.values())])
    x = lambda key: F.col(f"c{key[0]}")
    first = base.agg(F.count("*").alias("rows"), *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(names))],
                     *[F.kll_sketch_agg_double(f"c{i}", F.lit(SKETCH)).alias(f"s{i}") for i in range(len(names))]).first()
    n = {i: first[f"n{i}"] for i in range(len(names))}
    sizes = {name: (n[i], first["rows"] - n[i]) for i, name in enumerate(names)}
    keys = sorted({(i, lo, hi) for i, name in enumerate(names) if n[i] for lo, hi in wanted(name, *sizes[name])})
    todo = _brackets(df, [(k, first[f"s{k[0]}"], k[1] / n[k[0]] - ERROR, (k[2] + 1) / n[k[0]] + ERROR) for k in keys])
    inside = lambda k, b: (x(k) >= b[0]) & (x(k) <= b[1])
    done: dict[tuple, tuple] = {}  # key -> bracket, rows below it
    values: dict[str, dict[int, float]] = {name: {} for name in names}
    proven: dict[tuple, tuple] = {}  # key -> the last bracket that held its ranks, rows below and inside, next error
    while todo:
        own = list(todo.items())
        row = base.agg(*[F.count_if(x(k) < b[0]).alias(f"l{j}") for j, (k, b) in enumerate(own)],
                       *[F.count_if(inside(k, b)).alias(f"i{j}") for j, (k, b) in enumerate(own)],
                       *[F.count_if(x(k) == b[e]).alias(f"e{2 * j + e}") for j, (k, b) in enumerate(own) for e in (0, 1)]).first()
        todo, narrow = {}, []
        for j, (k, b) in enumerate(own):
            below, held = row[f"l{j}"], row[f"i{j}"]
            if below > k[1] or below + held <= k[2]:
                if k not in proven:
                    todo[k] = (-INF, INF)
                    continue
                last, below, held, wide = proven[k]  # narrowed too far: again, wider
                proven[k] = (last, below, held, 4 * wide)
            else:
                proven[k] = (b, below, held, ERROR)
                ends = [b[0] if r < below + row[f"e{2 * j}"] else b[1] if r >= below + held - row[f"e{2 * j + 1}"] else None for r in k[1:]]
                if None not in ends:
                    values[names[k[0]]].update((r, v + 0.0) for r, v in zip(k[1:], ends))  # 0.0 for -0.0, as grouping gives it
                    continue
            b, below, held, wide = proven[k]
            if held > MOST and b[0] < b[1] and wide < 1:
                narrow.append((k, (k[1] - below) / held - wide, (k[2] + 1 - below) / held + wide))
            else:
                done[k] = (b, below)
        if narrow:
            row = base.agg(*[F.kll_sketch_agg_double(F.when(inside(k, proven[k][0]), x(k)), F.lit(SKETCH)).alias(f"s{j}")
                             for j, (k, _, _) in enumerate(narrow)]).first()
            for k, b in _brackets(df, [(k, row[f"s{j}"], lo, hi) for j, (k, lo, hi) in enumerate(narrow)], proven).items():
                if b == tuple(proven[k][0]):  # nothing but ties left
                    done[k] = proven[k][:2]
                else:
                    todo[k] = b
    if done:
        own = list(done.items())
        near = base.where(_any([inside(k, b) for k, (b, _) in own]))
        found = near.select(F.inline(F.array_compact(F.array(*[
            F.when(inside(k, b), F.struct(F.lit(j).alias("key"), x(k).alias("value"))) for j, (k, (b, _)) in enumerate(own)]))))
        counted = found.groupBy("key", "value").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("key").orderBy("value"))  # at most MOST values a key, or ties
        place = F.element_at(F.array(*[F.array(F.lit(k[1] - below), F.lit(k[2] - below)) for k, (_, below) in own]), F.col("key") + 1)
        hit = F.exists(place, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
        for r in counted.withColumn("upto", upto).where(hit).collect():
            k, (_, below) = own[r["key"]]
            for rank in k[1:]:
                if r["upto"] - r["n"] <= rank - below < r["upto"]:
                    values[names[k[0]]][rank] = r["value"]
    return values, sizes


def between(values: dict[int, float], place: float) -> float:
    """The value at a place between two ranks, by linear interpolation."""
    lo, hi = values[math.floor(place)], values[math.ceil(place)]
    return lo if lo == hi else lo + (place - math.floor(place)) * (hi - lo)


def column_quantiles(df: DataFrame, columns: dict[str, Column], probs) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column (NULL and NaN left out; all missing: None)."""
    probs = [float(p) for p in probs]
    places = lambda n: [(n - 1) * p for p in probs]
    values, sizes = order_statistics(df, columns, lambda _, n, __: [(math.floor(x), math.ceil(x)) for x in places(n)])
    return {name: [between(values[name], x) for x in places(n)] if n else [None] * len(probs) for name, (n, _) in sizes.items()}


def filled_quartiles(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple | None]:
    """(median, q1, q3) of each column, the quartiles as if its missing values held the median.

    With g copies of the median merged in, the value at rank k is the middle one of the values at
    k and k - g of the column and the median, so nothing is scanned again. No values: None.
    """
    def ranks(n: int, gaps: int) -> list[int]:
        last = n + gaps - 1
        return [r for p in (0.25, 0.75) for r in (math.floor(last * p), math.ceil(last * p))]

    def wanted(_, n: int, gaps: int) -> list[tuple[int, int]]:
        middle = (math.floor((n - 1) / 2), math.ceil((n - 1) / 2))
        own = {k for r in ranks(n, gaps) for k in (r, r - gaps) if 0 <= k < n}
        return [middle, *((k, k) for k in own)]

    values, sizes = order_statistics(df, columns, wanted)
    out: dict[str, tuple | None] = {}
    for name, (n, gaps) in sizes.items():
        if not n:
            out[name] = None
            continue
        own, middle = values[name], between(values[name], (n - 1) / 2)
        merged = {r: max(min(own.get(r, INF), middle), own.get(r - gaps, -INF)) for r in ranks(n, gaps)} if gaps else own
        out[name] = (middle, between(merged, 0.25 * (n + gaps - 1)), between(merged, 0.75 * (n + gaps - 1)))
    return out


def _brackets(df: DataFrame, asked: list[tuple], held: dict | None = None) -> dict[tuple, tuple]:
    """(key, sketch, low place, high place) -> key: bracket, open where a place is at an end (within
    the bracket that ``held`` has)."""
    if not asked:
        return {}
    sketches = list({id(s): s for _, s, _, _ in asked}.values())
    at = {id(s): f"s{i}" for i, s in enumerate(sketches)}
    one = df.sparkSession.range(1).select(*[F.lit(bytearray(s)).alias(f"s{i}") for i, s in enumerate(sketches)])
    ends = one.select(*[F.kll_sketch_get_quantile_double(at[id(s)], F.lit(float(min(max(p, 0.0), 1.0)))).alias(f"q{2 * j + e}")
                        for j, (_, s, *places) in enumerate(asked) for e, p in enumerate(places)]).first()
    out = {}
    for j, (key, _, lo, hi) in enumerate(asked):
        least, most = held[key][0] if held else (-INF, INF)
        out[key] = (least if lo <= 0 else ends[2 * j], most if hi >= 1 else ends[2 * j + 1])
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
