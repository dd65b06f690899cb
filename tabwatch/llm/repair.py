"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation, as a sequence of role initials, is brought into the form ``(s?(ua)+)?`` by the
cheapest edits: Keep (0), Rerole to user or assistant (2), Delete (3; the only edit of a blank or
repeated row), Insert an empty user or assistant row (2); a truncated row that stays adds 1.

The form has four states: nothing yet, after the system row, after a user row, after an assistant
row. Inserts are counted with the row that they stand before, so the audits (edit initials) of a
stretch from one state all end with the edit of its last row: none is a prefix of another, and two
that are equal reach the same state. Hence an order of the states by their least audits can be
carried along with the costs, and the audit-least path needs no strings: a forward vector holds
four costs and four ranks, a backward vector four costs. They meet in the middle, the cheapest
crossing state of least rank is kept, and both halves are solved alone, in linear space.

On a cluster the first cuts are chunks of at most ``CHUNK`` neighbouring rows, dealt by range, so
that one conversation may lie in many tasks: a chunk gives the forward vectors from its four
states; a conversation's vectors meet at the chunk borders; then each chunk is solved alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, tasks, written

#: Rows, and bytes of text, of a chunk.
CHUNK = 4096
CHUNK_BYTES = 4 << 20
#: Copies of one row that one step writes out.
COPIES = 4096
INITIALS = {"s": 1, "u": 2, "a": 3}
ROLES = {"s": "system", "u": "user", "a": "assistant"}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
FAR = 1 << 60
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: The row that an insert adds in each state, and what it takes to end there.
INSERTED = ["u", "u", "a", "u"]
ENDING = [0, 4, 2, 0]
STEPS = ["D", "ID", "IK", "IR", "K", "R"]  # in ASCII order
_SPACE = " \t\n\x0b\x0c\r"


def code_of(role: str, fault: int) -> int:
    """What the edits of a row depend on: its initial, must it go, does keeping it cost 1."""
    return INITIALS.get(role[:1], 0) | (4 if fault in (BLANK, DUPLICATE) else 0) | (8 if fault == TRUNCATED else 0)


def _edits(code: int) -> list[tuple[int, int, int, int]]:
    """(from, step, to, cost) of every edit of a row; more than one insert before a row never pays."""
    out = []
    for state in range(4):
        for inserts in (0, 1):
            at = AFTER[state, INSERTED[state]] if inserts else state
            lead, cost = "I" * inserts, 2 * inserts
            out.append((state, STEPS.index(lead + "D"), at, cost + 3))
            if code & 4:
                continue
            cost += code >> 3
            own = " sua"[code & 3]
            if (at, own) in AFTER:
                out.append((state, STEPS.index(lead + "K"), AFTER[at, own], cost))
            for other in "ua":
                if (at, other) in AFTER:
                    out.append((state, STEPS.index(lead + "R"), AFTER[at, other], cost + 2))
    return out


EDITS = [_edits(code) for code in range(16)]


def start(state: int) -> tuple[list[int], list[int]]:
    return [0 if s == state else FAR for s in range(4)], [0] * 4


def forward(codes: bytes, vector: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """Costs of the four states after ``codes``, and the order of their least audits."""
    costs, ranks = vector
    for code in codes:
        best = [(FAR, 0, 0)] * 4
        for state, step, to, cost in EDITS[code]:
            if costs[state] < FAR:
                found = (costs[state] + cost, ranks[state], step)
                if found < best[to]:
                    best[to] = found
        order = sorted(range(4), key=lambda s: best[s][1:])
        costs, ranks = [b[0] for b in best], [0] * 4
        for rank, s in enumerate(order):
            ranks[s] = rank
    return costs, ranks


def backward(codes: bytes, costs: list[int]) -> list[int]:
    """What it costs from each of the four states to go through ``codes`` and end at ``costs``."""
    for code in reversed(codes):
        before = [FAR] * 4
        for state, _, to, cost in EDITS[code]:
            before[state] = min(before[state], cost + costs[to])
        costs = before
    return costs


def cross(costs: list[int], ranks: list[int], rest: list[int]) -> int:
    """The audit-least of the cheapest crossing states."""
    return min(range(4), key=lambda s: (costs[s] + rest[s], ranks[s]))


def solve(codes: bytes, entry: int, leave: int) -> list[int]:
    """Steps of the audit-least cheapest way through ``codes`` from state ``entry`` to ``leave``."""
    out, todo = [], [(0, len(codes), entry, leave)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            out.append(min((cost, step) for state, step, to, cost in EDITS[codes[lo]] if state == a and to == b)[1])
        elif hi > lo:
            mid = (lo + hi) // 2
            middle = cross(*forward(codes[lo:mid], start(a)), backward(codes[mid:hi], start(b)[0]))
            todo += [(mid, hi, middle, b), (lo, mid, a, middle)]
    return out


_CHUNK = ("conv_id long, part int, seq long, codes binary, costs array<long>, ranks array<int>, rows array<struct<turn:long,role:string,"
          "text:string,fault:int>>, entry int, leave int, last boolean")
_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]))
_CHUNK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), _ROWS, pa.int32(), pa.int32(), pa.bool_()]


def _names(schema: str) -> list[str]:
    """Names of a flat schema, or of _CHUNK."""
    return [x.split()[0] for x in schema.replace("turn:long,role:string,text:string,fault:int", "").split(", ")]


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, fault) -> one row a chunk, with its forward vectors. A
    conversation that begins and ends inside the task in one chunk has its states at once."""
    part, names = TaskContext.get().partitionId(), _names(_CHUNK)
    seq, at, rows, size, before, out, held = 0, None, [], 0, None, [], 0

    def chunk(inside: bool) -> tuple:
        codes = bytes(code_of(r["role"], r["fault"]) for r in rows)
        if inside:
            return at, part, seq, codes, None, None, rows, 0, cross(*forward(codes, start(0)), ENDING), True
        vectors = [forward(codes, start(s)) for s in range(4)]
        return at, part, seq, codes, [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]], rows, None, None, None

    for b in batches:
        for r in b.to_pylist():
            conv = r.pop("conv_id")
            if rows and (conv != at or len(rows) == CHUNK or size > CHUNK_BYTES):
                # before: whose chunk came last in this task (nothing yet: the conversation may have begun in another)
                out.append(chunk(conv != at and before is not None and before[0] != at))
                held += size
                before, seq, rows, size = (at,), seq + 1, [], 0
                if len(out) == 256 or held > CHUNK_BYTES:
                    yield _batch(out, names, _CHUNK_TYPES)
                    out, held = [], 0
            at = conv
            rows.append(r)
            size += len(r["text"])
    if rows:
        out.append(chunk(False))
    yield _batch(out, names, _CHUNK_TYPES)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunk vectors of one conversation -> the states at which each chunk begins and ends."""
    pdf = pdf.sort_values(["part", "seq"])
    costs = [np.reshape(c, (4, 4)).tolist() for c in pdf["costs"]]
    ranks = [np.reshape(r, (4, 4)).tolist() for r in pdf["ranks"]]
    rest = [ENDING]
    for c in reversed(costs):
        rest.append([min(x + y for x, y in zip(own, rest[-1])) for own in c])
    rest.reverse()
    entry, leave, state = [], [], 0
    for i in range(len(pdf)):
        entry.append(state)
        state = cross(costs[i][state], ranks[i][state], rest[i + 1])
        leave.append(state)
    return pdf[["conv_id", "part", "seq"]].assign(entry=entry, leave=leave, last=[False] * (len(pdf) - 1) + [True])


_EDITED = "conv_id long, part int, seq long, place int, edit string, turn long, role string, text string, was string, fault int, cost int"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their states -> their edits, in order."""
    names = _names(_EDITED)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int32()]
    for b in batches:
        out, held = [], 0
        for c in b.to_pylist():
            lead, place, state = (c["conv_id"], c["part"], c["seq"]), 0, c["entry"]

            def add(edit: str, turn, role: str, text: str, was, fault: int, cost: int) -> None:
                nonlocal place, held
                out.append((*lead, place, edit, turn, role, text, was, fault, cost))
                place, held = place + 1, held + len(text)

            def insert(state: int) -> int:
                add("I", None, ROLES[INSERTED[state]], "", None, 0, 2)
                return AFTER[state, INSERTED[state]]

            for r, code, step in zip(c["rows"], c["codes"], solve(c["codes"], c["entry"], c["leave"])):
                if len(STEPS[step]) > 1:
                    state = insert(state)
                edit, stays = STEPS[step][-1], int(r["fault"] == TRUNCATED)
                own = " sua"[code & 3] if edit == "K" else INSERTED[state]  # a rerole gives what an insert would add
                if edit == "D":
                    add("D", r["turn"], r["role"], r["text"], r["role"], r["fault"], 3)
                else:
                    state = AFTER[state, own]
                    add(edit, r["turn"], r["role"] if edit == "K" else ROLES[own], r["text"], r["role"], r["fault"], stays + 2 * (edit == "R"))
            while c["last"] and ENDING[state]:
                state = insert(state)
            if len(out) >= CHUNK or held > CHUNK_BYTES:
                yield _batch(out, names, types)
                out, held = [], 0
        yield _batch(out, names, types)


def _kept(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by crc32(``conv_id:turn``) modulo 20 (nulls: one
    space): 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    out = _kept(rows).withColumn("f", fault).where("f <> 0")
    text = F.when(F.col("f") == 1, F.lit("")).when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("f") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, fault: each row with its first fault (0 none, 1 blank, 2 the
    same role and text came before, 3 truncated). Equal rows are told apart by ``copy``."""
    keys = ["conv_id", "turn", "role", "text"]
    same = _kept(rows).groupBy(*keys).agg(F.count("*").alias("n")).withColumn(
        "said", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))))
    same = written(same, "repair-rows")
    first = same.groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(
        F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("least"))
    both = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")))
    new = F.when(F.col("unnumbered"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))
    both = both.select(*keys, "n", new.alias("new"), F.explode(blocks).alias("block"))
    copies = F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)
    both = both.select(*keys, "new", F.explode(copies).alias("copy"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    fault = (F.when(bare == "", BLANK).when(~F.col("new") | (F.col("copy") > 0), DUPLICATE)
             .when(~F.expr("right(bare, 1) in ('.', '!', '?')"), TRUNCATED).otherwise(0))
    return both.withColumn("bare", bare).select(*keys, "copy", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of ``rows`` (conv_id, turn: long; role, text: string).

    One row for each edit, in the order (part, seq, place): edit (D, I, K or R), turn, role and text
    (repaired; of a deleted row as they were), was (the role before; null for inserts), fault, cost.
    Rows are taken by turn, nulls first, then by role and text; null role and text count as one
    space; rows without a conv_id are one conversation. Of the cheapest ways to the form the one
    with the ASCII-least edits is taken. Rows that repeat are duplicates of each other. Other columns
    are ignored; an empty table has no edits. No conversation is held whole by a task, only
    chunks of ``CHUNK`` rows and one vector a chunk.
    """
    spark = rows.sparkSession
    prepare(spark)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("copy")]
    found = written(faults(rows), "repair-faults")
    dealt = found.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    chunks = written(dealt.select("conv_id", "turn", "role", "text", "fault").mapInArrow(_chunks, _CHUNK), "repair-chunks")
    kept = ["conv_id", "part", "seq", "codes", "rows"]
    # conversations that may lie in several tasks, or in several chunks: two a task, and the long ones
    open_ = chunks.where("entry is null")
    states = open_.select("conv_id", "part", "seq", "costs", "ranks").groupBy("conv_id").applyInPandas(
        _meet, "conv_id long, part int, seq long, entry int, leave int, last boolean")
    met = open_.select(*kept).join(states.drop("conv_id"), ["part", "seq"])  # part and seq name a chunk
    solved = chunks.where("entry is not null").select(*kept, "entry", "leave", "last").unionByName(met)
    return solved.select(*kept, "entry", "leave", "last").mapInArrow(_edited, _EDITED)


_DIGEST = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits sorted by conversation and place -> one row a conversation; texts pass by, none is held."""
    names, types = _names(_DIGEST), [*[pa.int64()] * 6, pa.string(), pa.string()]
    at, n, illegal, cost, audit, digest, before, any_ = None, [0] * 4, 0, 0, bytearray(), hashlib.sha256(), None, False
    for b in batches:
        out = []
        for conv, edit, role, text, was, fault, price in zip(*(c.to_pylist() for c in b.columns)):
            if any_ and conv != at:
                out.append((at, *n[1:], illegal, cost, audit.decode(), digest.hexdigest()))
                n, illegal, cost, audit, digest, before = [0] * 4, 0, 0, bytearray(), hashlib.sha256(), None
            if not any_ or conv != at:
                first = True
            at, any_ = conv, True
            audit += edit.encode()
            cost += price
            if edit != "I":
                n[fault] += 1
                illegal += before is not None and before + was[:1] not in ("su", "ua", "au")
                before = was[:1]
            if edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        yield _batch(out, names, types)
    if any_:
        yield _batch([(at, *n[1:], illegal, cost, audit.decode(), digest.hexdigest())], names, types)


def repair_report(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conv_id of ``rows``, for the repair of ``damaged``.

    Gaps and faults are those of ``damaged``; a conversation without rows there has zeros, an empty
    audit and the hash of nothing. The hash of a conversation is one sequential pass over its
    repaired rows, which are sorted and streamed; the audit is one letter an edit.
    """
    spark = rows.sparkSession
    order = [F.asc_nulls_first("conv_id"), F.asc("part"), F.asc("seq"), F.asc("place")]
    told = repair(damaged).repartition(tasks(spark), "conv_id").sortWithinPartitions(*order).select(
        "conv_id", "edit", "role", "text", "was", "fault", "cost").mapInArrow(_digests, _DIGEST)
    turns = damaged.select(F.col("conv_id").cast("long").alias("g"), F.col("turn").cast("long").alias("turn")).distinct()
    gaps = turns.groupBy("g").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
            .join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(gaps, F.col("id").eqNullSafe(F.col("g")), "left")
            .select(F.col("id").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
