"""Linking of tool calls with their results: join by identifier, order, validation, canonical JSON.

Records are calls (name, arguments as JSON text, ids of the calls they depend on) and results
(content), both with a conversation, a call id and a position.

* Link: a call and the first result of its (conversation, id) meet in a hash join.
* Order: a call comes after the calls it depends on. Where every dependency stands earlier the
  positions are such an order already, and nothing is moved. A dependency on a later call makes
  the stretch between the two a segment (overlapping ones are one); only segments are sorted
  topologically, each on its own, and their calls share out the segment's positions anew.
* Validate: the arguments of each call against the schema of its name.
* Serialise: JSON with sorted keys, no spaces and no escapes but the necessary ones.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwatch.llm.common import prepare, written

_LONE = re.compile("[\ud800-\udfff]")
_ORDER = "uid long, new_step long, cycle boolean"
_KINDS = {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (
            kind == "number" or value.is_integer()))
    return isinstance(value, _KINDS[kind])


def validate(value, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` has against a schema (type, enum, minimum, maximum, minLength, maxLength,
    required, properties, additionalProperties, items), in a fixed order."""
    if "type" in schema and not _is(value, schema["type"]):
        return [f"{at}: not of type {schema['type']}"]
    out = [f"{at}: not among the allowed values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{at}: shorter than {schema['minLength']}"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: longer than {schema['maxLength']}"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in known:
                out += validate(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            out += validate(x, schema["items"], f"{at}[{k}]")
    return out


def _plain(text: str) -> str:
    """Surrogates without a partner, which have no UTF-8, as the escapes that JSON has for them."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _number(text: str) -> float:
    raise ValueError(f"{text} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError(f"{text} has no finite value")
    return value


def describe(kind: str, call_id, name, body, result, depends_on, schemas: dict) -> tuple[bool | None, list[str], str]:
    """valid, errors and canonical JSON of one record."""
    if kind == "result":
        return None, [], canonical({"content": body, "id": call_id, "type": "tool_result"})
    try:
        arguments = json.loads(body, parse_constant=_number, parse_float=_finite)
        errors = [_plain(e) for e in validate(arguments, schemas[name])] if name in schemas else ["unknown tool"]
    except (TypeError, ValueError, RecursionError):
        arguments, errors = body, ["arguments are not JSON"]
    return not errors, errors, canonical({"arguments": arguments, "depends_on": sorted(d for d in depends_on or () if d is not None), "id": call_id,
                                          "name": name, "result": result, "type": "tool_call"})


def topological(calls: list[tuple[int, str]], needs: dict[int, list[int]]) -> tuple[list[int], set[int]]:
    """Indices of ``calls`` in order (earliest first where free), and those in or behind a cycle."""
    waits = {k: len(set(needs.get(k, ()))) for k in range(len(calls))}
    after: dict[int, list[int]] = {}
    for k, own in needs.items():
        for x in set(own):
            after.setdefault(x, []).append(k)
    free, out = [k for k, n in waits.items() if not n], []
    heapq.heapify(free)
    while free:
        k = heapq.heappop(free)
        out.append(k)
        for x in after.get(k, ()):
            waits[x] -= 1
            if not waits[x]:
                heapq.heappush(free, x)
    rest = sorted(set(range(len(calls))) - set(out))
    return out + rest, set(rest)


def _sorted_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["position", "uid"])
    at = {c: k for k, c in enumerate(pdf["call_id"])}
    needs = {k: [at[d] for d in ([] if own is None else own) if d in at] for k, own in enumerate(pdf["depends_on"])}
    order, cycle = topological(list(zip(pdf["position"], pdf["call_id"])), needs)
    uid, position = pdf["uid"].tolist(), pdf["position"].tolist()
    return pd.DataFrame({"uid": [uid[k] for k in order], "new_step": position, "cycle": [k in cycle for k in order]})


def link_tool_calls(records: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each record: conv_id, kind, call_id, position, status, step, in_cycle, valid,
    errors, message.

    ``records`` has conv_id (long), kind ("call" or "result"), call_id (string), position (long),
    name (string), body (string: a call's arguments, a result's content) and depends_on (array of
    strings). status of a call: "linked", "unanswered", or "duplicate" (a later call of the same
    id); of a result: "linked", "duplicate", or "orphan" (no such call). Records with a null
    conversation, id or position link with nothing. step: the place of a call in topological
    order, else the position; calls in or behind a cycle come last in their segment, by position.
    Dependencies on ids that the conversation lacks, on null, and of duplicates, don't order. Arguments
    with numbers beyond double precision's range are not JSON; a surrogate without a partner is
    written as its escape. A null kind
    or other kinds are left out of the tool records and not returned; other columns are ignored;
    equal rows are records of their own; an empty table gives no rows.
    """
    spark = records.sparkSession
    prepare(spark)
    own = records.where(F.col("kind").isin("call", "result")).select(
        F.col("conv_id").cast("long").alias("conv_id"), "kind", "call_id", F.col("position").cast("long").alias("position"), "name", "body", "depends_on")
    own = written(own.withColumn("uid", F.monotonically_increasing_id()), "tool-records")
    key = ["conv_id", "call_id"]
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("position").isNotNull()
    at = F.struct("position", "uid")
    calls = own.where((F.col("kind") == "call") & whole).groupBy(*key).agg(F.min(at).alias("call"))
    results = own.where((F.col("kind") == "result") & whole).groupBy(*key).agg(F.min(at).alias("answer"), F.min_by("body", at).alias("result"))
    first = written(calls.join(results, key, "full_outer"), "tool-first")
    found = own.join(first, key, "left")
    mine = lambda c: F.coalesce(whole & (F.col("uid") == F.col(f"{c}.uid")), F.lit(False))
    status = F.when(F.col("kind") == "call", F.when(~whole, "unanswered").when(~mine("call"), "duplicate")
                    .when(F.col("answer").isNull(), "unanswered").otherwise("linked"))
    status = status.otherwise(F.when(~whole | F.col("call").isNull(), "orphan").when(~mine("answer"), "duplicate").otherwise("linked"))
    found = written(found.withColumn("status", status).withColumn("result", F.when(F.col("status") == "linked", F.col("result"))), "tool-linked")

    # order: dependencies on later calls open segments
    active = found.where((F.col("kind") == "call") & whole & (F.col("status") != "duplicate"))
    needed = active.select("conv_id", "position", "uid", F.explode("depends_on").alias("call_id")).join(
        first.where("call is not null").select(*key, F.col("call.position").alias("last")), key)
    spans = needed.where("last >= position").groupBy("conv_id", "position").agg(F.max("last").alias("last"))
    line = Window.partitionBy("conv_id").orderBy("position")
    spans = spans.withColumn("reach", F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("segment", F.sum(F.when(F.col("reach") >= F.col("position"), 0).otherwise(1)).over(line))
    segments = spans.groupBy("conv_id", "segment").agg(F.min("position").alias("begin"), F.max("last").alias("end"))
    # a call's segment is the last that begins at or before it: one walk over the calls, no pairs with all segments
    inside = active.select("conv_id", "position", F.lit(1).alias("kind"), "call_id", "uid", "depends_on", F.lit(None).cast(
        "struct<begin:bigint,end:bigint>").alias("opened")).unionByName(
        segments.select("conv_id", F.col("begin").alias("position"), F.lit(0).alias("kind"), F.struct("begin", "end").alias("opened")), allowMissingColumns=True)
    walk = Window.partitionBy("conv_id").orderBy("position", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("own", F.last("opened", ignorenulls=True).over(walk)).where("kind = 1 and position <= own.end")
    inside = inside.select("conv_id", "call_id", "position", "uid", "depends_on", F.col("own.begin").alias("segment"))
    moved = inside.groupBy("conv_id", "segment").applyInPandas(_sorted_segment, _ORDER)
    found = found.join(moved, "uid", "left")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(r["kind"], r["call_id"], r["name"], r["body"], r["result"], r["depends_on"], schemas) for r in b.to_pylist()]
            keep = ["conv_id", "kind", "call_id", "position", "status", "step", "in_cycle"]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.names.index(c)) for c in keep], pa.array([r[0] for r in rows], pa.bool_()),
                 pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.string())],
                names=[*keep, "valid", "errors", "message"])

    found = found.select("conv_id", "kind", "call_id", "position", "status", F.coalesce("new_step", "position").alias("step"),
                         F.coalesce("cycle", F.lit(False)).alias("in_cycle"), "name", "body", "result", "depends_on")
    return found.mapInArrow(told, "conv_id long, kind string, call_id string, position long, status string, step long, "
                                  "in_cycle boolean, valid boolean, errors array<string>, message string")


def from_conversations(turns: DataFrame) -> DataFrame:
    """Tool records out of plain conversations (conv_id, turn, role, text).

    The conversations hold no tool calls, so their turns are read as such: an assistant's turn is
    a call with its text as an argument, a user's turn is the result of the call in the turn
    before, and a system turn is a result that nobody asked for. Calls of a multiple of three words depend on
    the assistant's turn before, calls of a multiple of seven on the one after.
    """
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    turn, call = F.col("turn").cast("long"), lambda c: F.concat(F.lit("c"), c.cast("string"))
    names = F.array(F.lit("search"), F.lit("translate"), F.lit("summarise"))
    needs = F.filter(F.array(F.when(F.col("n") % 3 == 0, call(turn - 2)), F.when(F.col("n") % 7 == 0, call(turn + 2))), lambda x: x.isNotNull())
    is_call = F.col("role") == "assistant"
    arguments = F.to_json(F.struct(F.col("text").alias("text"), F.col("n").alias("words"), F.col("role").alias("asked_by")), {"ignoreNullFields": "false"})
    return turns.withColumn("n", n).select(
        "conv_id", F.when(is_call, "call").otherwise("result").alias("kind"),
        F.when(is_call, call(turn)).when(F.col("role") == "user", call(turn - 1)).otherwise("none").alias("call_id"),
        turn.alias("position"), F.when(is_call, F.element_at(names, (F.pmod(F.coalesce(turn, F.lit(0)), F.lit(3)) + 1).cast("int"))).alias("name"),
        F.when(is_call, arguments).otherwise(F.col("text")).alias("body"), F.when(is_call, needs).otherwise(F.array().cast("array<string>")).alias("depends_on"))


#: Schemas of the tools that ``from_conversations`` names.
SCHEMAS = {
    "search": {"type": "object", "required": ["text", "words"], "additionalProperties": False, "properties": {
        "text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 150},
        "asked_by": {"type": "string", "enum": ["assistant", "user"]}}},
    "translate": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "maxLength": 1000}}},
    "summarise": {"type": "object", "required": ["text", "words"], "properties": {
        "text": {"type": "string"}, "words": {"type": "integer", "minimum": 20}}},
}
