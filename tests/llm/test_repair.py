import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabwatch.llm import repair

SPACES = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 1:
            text = ""
        if f == 2:
            text = "".join(c for c in text if c not in ".!?")
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(f, 1)
    return out


def first_faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Uniform-cost search over all edits, ties by the audit: (cost, audit, repaired)."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if len(audit) > 2 * len(rows) + 3 or cost > 3 * len(rows):
            continue
        for c, name in (("u", "user"), ("a", "assistant")):
            if (state, c) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, c], (*kept, name + ":")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*kept, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (state, c) in NEXT:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, NEXT[state, c], (*kept, f"{name}:{text}")))
    raise AssertionError


def report(rows):
    low = lambda x: (x is not None, x or 0)
    out = {}
    hurt = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (low(r[1]), r[2], r[3]))
        faults = first_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, kept = cheapest(own, faults) if own else (0, "", ())
        initials = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def told(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, fault string")
    got = repair.repair_report(df, repair.damage(df)).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so on", " \n", "", None, "Well?  ", "é …", "x" * 3000 + "."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), role, rng.choice([f"Text {rng.randrange(50)}."] * 6 + texts)))
    return rows + [(None, 1, "user", "Hm."), (None, None, None, None), (None, 0, "system", "S."), rows[0], rows[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_search_of_all_edits(spark, seed):
    rows = conversations(seed, 60)
    assert told(spark, rows) == report(rows)


def test_chunks_meet_as_one_piece(spark, monkeypatch):
    rows = conversations(3, 40)
    monkeypatch.setattr(repair, "CHUNK", 2)
    monkeypatch.setattr(repair, "COPIES", 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = {r.conv_id: r for r in repair.repair_report(df, repair.damage(df)).collect()}
    assert {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for k, r in one.items()} == report(rows)


def test_one_long_conversation(spark):
    """Spread over several tasks; the same steps as one forward pass with whole strings."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"t{t}.", f"t{t}"])) for t in range(9000)]
    hurt = sorted(damaged(rows), key=lambda r: (r[1], r[2], r[3]))
    codes = [repair.code_of(r[2], {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[f]) for r, f in zip(hurt, first_faults(hurt))]
    best = {0: (0, "")}
    for code in codes:
        new = {}
        for state, step, to, cost in repair.EDITS[code]:
            if state in best:
                new[to] = min(new.get(to, (1 << 60, "")), (best[state][0] + cost, best[state][1] + repair.STEPS[step]))
        best = new
    cost, audit = min((c + repair.ENDING[s], a + "I" * (repair.ENDING[s] // 2)) for s, (c, a) in best.items())
    got = told(spark, rows)[7]
    assert got[5:7] == (cost, audit)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(df, repair.damage(df)).count() == 0
    assert repair.repair(df).count() == 0


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "U."), (1, 2, "user", "V."), (1, 3, "assistant", "A."), (1, 4, "assistant", "B.")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("part", "seq", "place").collect()
    assert "".join(r.edit for r in got) == "KKIKKIK"
    assert [(r.role, r.text) for r in got if r.edit == "I"] == [("assistant", ""), ("user", "")]
    assert sum(r.cost for r in got) == 4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=9))
def test_steps_are_the_least_audit(codes):
    rows = [(0, i, {0: "x", 1: "s", 2: "u", 3: "a"}[c & 3], f"{i}") for i, c in enumerate(codes)]
    faults = ["blank" if c & 4 else "truncated" if c & 8 else "" for c in codes]
    codes = bytes(repair.code_of(r[2], {"": 0, "blank": 1, "truncated": 3}[f]) for r, f in zip(rows, faults))
    costs, ranks = repair.forward(codes, repair.start(0))
    state = repair.cross(costs, ranks, repair.ENDING)
    steps = "".join(repair.STEPS[s] for s in repair.solve(codes, 0, state)) + "I" * (repair.ENDING[state] // 2)
    assert (costs[state] + repair.ENDING[state], steps) == cheapest(rows, faults)[:2]
