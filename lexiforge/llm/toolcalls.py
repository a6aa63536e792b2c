"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

A turn is split into items: a message, the calls of an assistant's turn, or a result. An assistant's turn makes calls if
its text is a JSON object with a list "tool_calls" of objects with "id", "name", "arguments" and, optionally, "depends_on"
(ids). A turn of role "tool" is a result: a JSON object with "tool_call_id" and "content". All else is a message.

Results are hash-joined with calls by conversation and identifier. Items are ordered topologically: a call comes after the
results of the calls it depends on, a result after its call. Order within a conversation is by (anchor, depth, turn,
item): along every dependency the anchor does not fall and the depth rises. Arguments are validated against the tool's schema.
Each item is one row, so no conversation is ever gathered in one task; transcripts() does that where it is wanted.

Statuses: ok; no_result (a call); invalid_arguments, unknown_tool (a call); duplicate_call, duplicate_result (a later item
of the same identifier; it is linked with nothing); orphan_result (no such call); cycle (a call that depends on
itself by others). Dependencies on calls that don't exist are ignored.

Defined cases: a null text is an empty message, a null role the role "unknown"; text that is no JSON of these forms is a message
(or, of role "tool", a result without identifier: an orphan). Rows with equal conv_id and turn are told apart by
their content; equal rows are one row. Rows without conv_id form one conversation, apart from all others. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io

#: Tools and their arguments: name, (JSON type, whether it is required).
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
    "write_file": {"path": ("string", True), "content": ("string", True), "append": ("boolean", False)},
}
_FIELDS = {"kind": "string", "call_id": "string", "name": "string", "valid": "string", "needs": "array<string>", "json": "string"}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, plain Unicode, and whole floats written as integers."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x == int(x) and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def validity(name, arguments, schemas: dict) -> str:
    """ok, unknown_tool or invalid_arguments."""
    if name not in schemas:
        return "unknown_tool"
    schema = schemas[name]
    if not isinstance(arguments, dict) or any(k not in schema for k in arguments):
        return "invalid_arguments"
    for key, (kind, required) in schema.items():
        if key not in arguments:
            if required:
                return "invalid_arguments"
        elif not isinstance(arguments[key], _TYPES[kind]) or (kind in ("integer", "number") and isinstance(arguments[key], bool)):
            return "invalid_arguments"
    return "ok"


def _load(text: str | None):
    if not text or text.lstrip()[:1] != "{":
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def items(role: str | None, text: str | None, schemas: dict) -> list[dict]:
    """The items of a turn, in order."""
    role = role if role is not None else "unknown"
    one = lambda kind, value, **x: {"kind": kind, "call_id": None, "name": None, "valid": None, "needs": [], "json": canonical(value)} | x
    made = _load(text)
    if role == "tool":
        known = isinstance(made, dict) and isinstance(made.get("tool_call_id"), str)
        call_id, content = (made["tool_call_id"], made.get("content")) if known else (None, text or "")
        return [one("result", {"role": "tool", "tool_call_id": call_id, "content": content}, call_id=call_id)]
    calls = made.get("tool_calls") if role == "assistant" and isinstance(made, dict) else None
    if not isinstance(calls, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        return [one("message", {"role": role, "content": text or ""})]
    out = [one("message", {"role": role, "content": made["content"]})] if made.get("content") is not None else []
    for c in calls:
        arguments = c.get("arguments")
        arguments = _load(arguments) if isinstance(arguments, str) else arguments
        name = c.get("name") if isinstance(c.get("name"), str) else None
        needs = [x for x in c.get("depends_on") or [] if isinstance(x, str)] if isinstance(c.get("depends_on"), list) else []
        out.append(one("call", {"role": "assistant", "tool_call": {"id": c["id"], "name": name, "arguments": arguments}}, call_id=c["id"], name=name, valid=validity(name, arguments, schemas), needs=needs))
    return out


def _splitter(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
                rows += [{"conv_id": conv_id, "turn": turn, "item": k, **x} for k, x in enumerate(items(role, text, schemas))]
            kinds = [("conv_id", pa.string()), ("turn", pa.int64()), ("item", pa.int32()), *((k, pa.list_(pa.string()) if "<" in v else pa.string()) for k, v in _FIELDS.items())]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])

    return run


def _firsts(rows: DataFrame) -> DataFrame:
    """conv_id, call_id and the place of each identifier's first item."""
    return rows.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "item", "json")).alias("first"))


def linked(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, item, kind, call_id, status, anchor, depth, json of each item of the conversations (conv_id, turn, role, text)."""
    ddl = "conv_id string, turn long, item int, " + ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(""))  # a name that joins well; null is none of the numbers
    turns = turns.select(conv.alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), "role", "text").distinct()
    told, _ = _io.stored(turns.mapInArrow(_splitter(SCHEMAS if schemas is None else schemas), ddl), "chat-items")
    place = F.struct("turn", "item", "json")
    calls, results = told.where("kind = 'call'"), told.where("kind = 'result' and call_id is not null")
    first_calls = _firsts(calls).withColumnRenamed("first", "call_at")
    first_results = _firsts(results).withColumnRenamed("first", "result_at")
    # depth and anchor of each call, a layer of the dependency graph at a time
    own = calls.join(first_calls, ["conv_id", "call_id"]).where(place == F.col("call_at")).select("conv_id", "call_id", "turn", F.array_distinct("needs").alias("needs"))
    edges = own.select("conv_id", "call_id", F.explode("needs").alias("need")).join(own.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi")
    edges, _ = _io.stored(edges, "chat-edges")
    waits = edges.select("conv_id", "call_id").distinct()
    done, _ = _io.stored(own.join(waits, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.col("turn").alias("anchor"), F.lit(0).alias("depth")), "chat-layer")
    results_at = first_results.select("conv_id", "call_id", F.col("result_at.turn").alias("result_turn"))
    while not edges.isEmpty():
        # a call is ready when all calls that it needs are placed; it comes after their results
        after = edges.join(done.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left").join(results_at.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
        ready = after.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("depth").alias("k"), F.max(F.greatest("anchor", "result_turn")).alias("a"), F.max("depth").alias("d")).where("n = k")
        ready = ready.join(own, ["conv_id", "call_id"]).select("conv_id", "call_id", F.greatest("turn", "a").alias("anchor"), (F.col("d") + 2).alias("depth"))
        ready, _ = _io.stored(ready, "chat-layer")
        if ready.isEmpty():
            break  # what is left is on a cycle or behind one
        edges, _ = _io.stored(edges.join(ready, ["conv_id", "call_id"], "left_anti"), "chat-edges")
        done = done.union(ready)
    at = F.struct(F.col("turn"), F.col("item"), F.col("json"))
    # messages have nothing to join: a conversation with very many turns isn't gathered
    rows = told.where("call_id is not null").join(first_calls, ["conv_id", "call_id"], "left").join(first_results, ["conv_id", "call_id"], "left").join(done, ["conv_id", "call_id"], "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(call & (at != F.col("call_at")), "duplicate_call")
        .when(call & F.col("anchor").isNull(), "cycle")
        .when(call & (F.col("valid") != "ok"), F.col("valid"))
        .when(call & F.col("result_at").isNull(), "no_result")
        .when(result & F.col("call_at").isNull(), "orphan_result")
        .when(result & (at != F.col("result_at")), "duplicate_result")
        .otherwise("ok")
    )
    first = F.when(call, F.col("call_at")).otherwise(F.col("result_at"))
    plain = F.col("anchor").isNull() | (at != first)
    anchor = F.when(plain, F.col("turn")).when(result, F.greatest("turn", "anchor")).otherwise(F.col("anchor"))
    depth = F.when(plain, 0).when(result, F.col("depth") + 1).otherwise(F.col("depth"))
    joined = rows.select("conv_id", "turn", "item", "kind", "call_id", status.alias("status"), anchor.alias("anchor"), depth.cast("int").alias("depth"), "json")
    alone = F.when(result, "orphan_result").otherwise("ok")
    every = joined.union(told.where("call_id is null").select("conv_id", "turn", "item", "kind", "call_id", alone, "turn", F.lit(0), "json"))
    return every.withColumn("conv_id", F.col("conv_id").try_cast("long"))


#: Turns of which one in a row of calls stands alone: the calls of the turns after it each need the one before.
CHAIN = 8


def with_calls(turns: DataFrame) -> DataFrame:
    """Turns of prose with calls and results made of them: every turn stays, and a table without tool calls gets some to link.

    An assistant's turn k also makes the call "t<k>" of search for its text, which needs the call "t<k - 2>" unless k modulo CHAIN
    is less than 2; so chains are short however long a conversation is. A user's turn k is also followed by the result of
    the call "t<k - 1>" with its text, whether or not there is such a call. Other turns stay as they are.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda k: F.concat(F.lit("t"), (F.col("turn") - k).cast("string"))
    text = F.coalesce("text", F.lit(""))
    needs = F.when(F.pmod("turn", F.lit(CHAIN)) >= 2, F.array(name(2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(name(0).alias("id"), F.lit("search").alias("name"), F.struct(text.alias("query")).alias("arguments"), needs.alias("depends_on"))
    spoken = F.when((F.col("role") == "assistant") & F.col("turn").isNotNull(), F.to_json(F.struct(text.alias("content"), F.array(call).alias("tool_calls")))).otherwise(F.col("text"))
    answered = turns.where("role = 'user' and turn is not null").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(name(1).alias("tool_call_id"), text.alias("content"))).alias("text"))
    return turns.withColumn("text", spoken).union(answered)


def transcripts(turns: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, n_items and the canonical JSON array of each conversation's items in order, without duplicates and orphans. A conversation must fit in a task."""
    good = linked(turns, schemas).where(~F.col("status").isin("duplicate_call", "duplicate_result", "orphan_result"))
    order = F.array_sort(F.collect_list(F.struct("anchor", "depth", "turn", "item", "json")))
    return good.groupBy("conv_id").agg(order.alias("x")).select("conv_id", F.size("x").alias("n_items"), F.concat(F.lit("["), F.array_join(F.col("x.json"), ","), F.lit("]")).alias("json"))
