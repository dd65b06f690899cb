import json

import pytest
from conftest import SF_SMALL
from tabwatch.llm import toolcalls as T

SCHEMA = "conv_id long, kind string, call_id string, position long, name string, body string, depends_on array<string>, status string, uid string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def brute(rows):
    """Status and step by plain loops; equal rows are told apart by their order alone."""
    first, answer = {}, {}
    for k, (conv, kind, call, position, *_) in enumerate(rows):
        if conv is None or call is None or position is None:
            continue
        seen = first if kind == "call" else answer
        if (conv, call) not in seen or position < rows[seen[conv, call]][3]:
            seen[conv, call] = k
    out = []
    for k, (conv, kind, call, position, *_) in enumerate(rows):
        key, known = (conv, call), None not in (conv, call, position)
        if kind == "call":
            s = "unanswered" if not known else "duplicate" if first[key] != k else "linked" if key in answer else "unanswered"
        else:
            s = "orphan" if not known or key not in first else "linked" if answer[key] == k else "duplicate"
        out.append((conv, kind, call, position, s))
    return out


ROWS = [
    (1, "call", "a", 0, "search", '{"text":"x","words":3}', []),
    (1, "result", "a", 1, None, "found", None),
    (1, "result", "a", 5, None, "again", None),
    (1, "call", "b", 2, "search", '{"words":0,"more":1}', ["c", "a"]),
    (1, "call", "c", 3, "translate", '{"text":"é"}', None),
    (1, "call", "a", 4, "search", "{}", []),
    (2, "call", "a", 0, "nothing", "[1]", ["zz"]),
    (2, "call", "x", 1, "translate", "not json", ["y"]),
    (2, "call", "y", 2, "translate", "NaN", ["x"]),
    (2, "call", "z", 4, "translate", None, ["y"]),
    (2, "result", "q", 3, None, None, None),
    (None, "call", "a", 0, "search", "{}", []),
    (3, "call", None, 0, "search", "{}", []),
    (3, "result", "a", None, None, "", []),
    (3, "other", "a", 0, None, None, None),
]


def test_links_order_and_messages(spark):
    got = T.link_tool_calls(records(spark, ROWS), T.SCHEMAS).collect()
    want = brute([r for r in ROWS if r[1] != "other"])
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r.conv_id, r.kind, r.call_id, r.position, r.status) for r in got), key=key) == sorted(want, key=key)
    by = {(r.conv_id, r.kind, r.call_id, r.position): r for r in got}
    assert by[1, "call", "c", 3].step == 2 and by[1, "call", "b", 2].step == 3  # b waits for c
    assert by[2, "call", "x", 1].in_cycle and by[2, "call", "y", 2].in_cycle and not by[2, "call", "a", 0].in_cycle
    a = by[1, "call", "a", 0]
    assert a.valid and a.message == '{"arguments":{"text":"x","words":3},"depends_on":[],"id":"a","name":"search","result":"found","type":"tool_call"}'
    assert by[1, "call", "b", 2].errors == ["$.text: missing", "$.more: not allowed", "$.words: below 1"]
    assert by[2, "call", "a", 0].errors == ["unknown tool"]
    assert all(by[k].errors == ["arguments are not JSON"] for k in by if k[0] == 2 and k[1] == "call" and k[2] in "xyz")
    assert by[1, "call", "c", 3].message.startswith('{"arguments":{"text":"é"}')


def test_validation():
    check = lambda v, **s: T.validate(v, s)
    assert check(True, type="integer") and not check(2.0, type="integer") and check(2.5, type="integer")
    assert check("ab", maxLength=1) and check("", minLength=1) and not check("ab", enum=["ab"])
    assert check([1, "x"], items={"type": "number"}) == ["$[1]: not of type number"]


def test_topological_order_of_any_graph():
    order, cycle = T.topological([(k, str(k)) for k in range(6)], {0: [3, 3], 1: [0], 4: [5], 5: [4]})
    assert cycle == {4, 5} and order.index(3) < order.index(0) < order.index(1) and sorted(order) == list(range(6))


def test_conversations(spark):
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    own = T.from_conversations(turns)
    got = T.link_tool_calls(own, T.SCHEMAS)
    rows, source = got.collect(), own.collect()
    assert len(rows) == turns.count()
    want = brute([(r.conv_id, r.kind, r.call_id, r.position) for r in source])
    assert sorted(map(str, want)) == sorted(str((r.conv_id, r.kind, r.call_id, r.position, r.status)) for r in rows)
    step = {(r.conv_id, r.call_id): r for r in rows if r.kind == "call"}
    for r in source:
        for d in r.depends_on or []:
            a, b = step.get((r.conv_id, r.call_id)), step.get((r.conv_id, d))
            if r.kind == "call" and b is not None and not a.in_cycle:
                assert b.step < a.step
    for r in rows:
        assert T.canonical(json.loads(r.message)) == r.message


@pytest.mark.parametrize("empty", [True])
def test_empty_table(spark, empty):
    assert T.link_tool_calls(records(spark, []), T.SCHEMAS).count() == 0


def test_odd_arguments_are_told_and_do_not_crash(spark):
    lone = '{"text":"\\ud800x","words":3,"\\udc01":1}'
    rows = [(1, "call", "a", 0, "search", lone, [None, "b"]), (1, "call", "b", 1, "search", '{"text":1e999,"words":2}', None),
            (1, "call", "c", 2, "search", "[" * 100_000, [None]), (1, "call", "d", 3, None, '{"n":' + "9" * 6000 + "}", ["d"])]
    schema = "conv_id long, kind string, call_id string, position long, name string, body string, depends_on array<string>"
    got = {r.call_id: r for r in T.link_tool_calls(spark.createDataFrame(rows, schema), T.SCHEMAS).collect()}
    assert got["a"].message.startswith('{"arguments":{"text":"\\ud800x","words":3,"\\udc01":1},"depends_on":["b"]')
    assert got["a"].errors == ["$.\\udc01: not allowed"] and json.loads(got["a"].message)["arguments"]["text"] == "\ud800x"
    assert all(got[k].errors == ["arguments are not JSON"] for k in "bc") and not got["d"].valid
    assert got["b"].step < got["a"].step and got["d"].in_cycle


def test_segments_of_one_long_conversation(spark):
    """Chains that begin, end and nest at many places of one conversation."""
    import random
    rng = random.Random(8)
    rows = [(1, "call", f"c{k}", k // 2, "search", "{}", [f"c{k + rng.randint(-6, 6)}"] if rng.random() < 0.3 else []) for k in range(600)]
    schema = "conv_id long, kind string, call_id string, position long, name string, body string, depends_on array<string>"
    got = {r.call_id: r for r in T.link_tool_calls(spark.createDataFrame(rows, schema), T.SCHEMAS).collect()}
    for _, _, call, position, _, _, needs in rows:
        for d in needs:
            if d in got and d != call and not got[call].in_cycle:
                assert got[d].step <= got[call].step
    assert sorted(r.step for r in got.values()) == sorted(k // 2 for k in range(600))
