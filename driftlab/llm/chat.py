"""Operator 8: chat formatting with linked tool calls.

Messages are rows (conv_id, turn, role, text). An assistant's text may hold calls, each as
``<tool_call>{"id": .., "name": .., "arguments": {..}}</tool_call>``; a row with the role ``tool`` is a result,
``{"tool_call_id": .., "content": ..}``; a system text may declare tools, ``<tools>[{"name": .., "parameters": schema}]
</tools>``; an argument ``{"$result": id}`` stands for the result of another call. Calls and results are linked by a
hash join on (conversation, identifier); arguments are validated against the JSON schema of the tool (the
conversation's own, else one given to the operator), found by a join as well.

Order: a result comes after its call, and a call after the results it uses. Where turns already say so, nothing moves.
Else a message is held until the turn of what it waits for: ``order_turn``, with ``order_level`` counting steps within
that turn, found by rounds over the links of such conversations alone (each round settles every message whose
predecessors are settled). Sorting by (conv_id, order_turn, order_level, turn) is a topological order; messages in or
behind a cycle keep their turn and are marked.

Each message becomes one line of canonical JSON: sorted keys, no spaces, shortest escapes, UTF-8. There is one row for
each message, so no conversation is ever gathered in one place.

Defined results: a null text is content null; a null role is role null; null conversation ids or turns are values like
any other, but link nothing; repeated rows are messages of their own with the same links; of calls with the same
identifier in a conversation the first (turn, place) owns it and the others are marked; extra columns don't matter; an
empty table gives no rows. JSON that is nested more than ``MAX_DEPTH`` deep, or has NaN, an infinity or a number beyond
all floats, is no JSON here; a lone surrogate escape becomes U+FFFD, in identifiers too. Problems: bad_call (no JSON
object, name or identifier), bad_result, duplicate_id, unknown_tool, bad_schema (a keyword with a value of the wrong
kind: nothing is validated), invalid_arguments, no_result, orphan_result, cycle.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, in_arrow, table

MAX_DEPTH = 200
_CALL = re.compile(r"(?s)<tool_call>(.*?)</tool_call>")
_TOOLS = re.compile(r"(?s)<tools>(.*?)</tools>")
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


def canonical(x) -> str:
    return _whole(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _whole(text: str) -> str:
    """text as it can be encoded: a surrogate without its other half becomes U+FFFD."""
    return _LONE.sub("\ufffd", text)


def _finite(digits: str) -> float:
    x = float(digits)
    if math.isinf(x):
        raise ValueError("a number beyond all floats")
    return x


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def load(text: str):
    """The JSON value of text; ValueError for what is no JSON (NaN and infinities too) or is nested more than MAX_DEPTH deep."""
    try:
        x = json.loads(text, parse_float=_finite, parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    level = [x]
    for _ in range(MAX_DEPTH):
        level = [v for y in level if isinstance(y, dict | list) for v in (y.values() if isinstance(y, dict) else y)]
        if not level:
            return x
    raise ValueError("nested too deeply")


def sound(schema) -> bool:
    """Whether each keyword that fits() knows has a value of the kind it needs, in the schema and those within it."""
    if isinstance(schema, bool):
        return True
    if not isinstance(schema, dict):
        return False
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    names = lambda x: isinstance(x, list) and all(isinstance(v, str) for v in x)
    kinds = {
        "type": lambda x: isinstance(x, str) or names(x), "enum": lambda x: isinstance(x, list), "required": names, "minimum": number, "maximum": number,
        "properties": lambda x: isinstance(x, dict) and all(map(sound, x.values())), "additionalProperties": sound, "items": sound,
    }
    kinds |= dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems"), number)
    return all(ok(schema[k]) for k, ok in kinds.items() if k in schema)


def fits(x, schema) -> bool:
    """Whether x meets a sound JSON schema: type, enum, const, properties, required, additionalProperties, items and limits."""
    if isinstance(schema, bool) or not isinstance(schema, dict):
        return schema is not False
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any((number if k == "number" else number and (isinstance(x, int) or x.is_integer()) if k == "integer" else isinstance(x, _TYPES.get(k, ()))) for k in kinds):
        return False
    if "enum" in schema and canonical(x) not in map(canonical, schema["enum"]) or "const" in schema and canonical(x) != canonical(schema["const"]):
        return False
    if number and not schema.get("minimum", x) <= x <= schema.get("maximum", x):
        return False
    if isinstance(x, str) and not schema.get("minLength", 0) <= len(x) <= schema.get("maxLength", len(x)):
        return False
    if isinstance(x, list):
        return schema.get("minItems", 0) <= len(x) <= schema.get("maxItems", len(x)) and all(fits(v, schema.get("items", True)) for v in x)
    if isinstance(x, dict):
        own = schema.get("properties", {})
        return all(k in x for k in schema.get("required", [])) and all(fits(v, own.get(k, schema.get("additionalProperties", True))) for k, v in x.items())
    return True


def references(x) -> list[str]:
    if isinstance(x, dict):
        return [_whole(x["$result"])] if x.keys() == {"$result"} and isinstance(x["$result"], str) else [r for v in x.values() for r in references(v)]
    return [r for v in x for r in references(v)] if isinstance(x, list) else []


def _object(text: str) -> dict | None:
    try:
        x = load(text)
    except ValueError:
        return None
    return x if isinstance(x, dict) else None


def parse(role: str | None, text: str | None) -> dict:
    """Content, calls, result and declared tools of one message."""
    out = {"content": canonical(text), "calls": [], "result_id": None, "tools": [], "bad": None}
    if role == "assistant" and text and "<tool_call>" in text:
        out["content"] = canonical(_CALL.sub("", text).strip())
        for m in _CALL.finditer(text):
            c = _object(m[1]) or {}
            ok = isinstance(c.get("id"), str) and isinstance(c.get("name"), str) and isinstance(c.get("arguments", {}), dict)
            a = c.get("arguments", {}) if ok else {}
            out["calls"].append({"id": _whole(c["id"]) if ok else None, "name": _whole(c["name"]) if ok else None, "arguments": canonical(a), "refs": sorted(set(references(a))), "raw": None if ok else canonical(m[1])})
    elif role == "tool":
        r = _object(text or "")
        if r is None or not isinstance(r.get("tool_call_id"), str):
            out["bad"] = "bad_result"
        else:
            out |= {"result_id": _whole(r["tool_call_id"]), "content": canonical(r.get("content"))}
    elif role == "system" and text and "<tools>" in text:
        for m in _TOOLS.finditer(text):
            try:
                listed = load(m[1])
            except ValueError:
                listed = []
            out["tools"] += [{"name": _whole(t["name"]), "schema": canonical(t.get("parameters", {}))} for t in (listed if isinstance(listed, list) else []) if isinstance(t, dict) and isinstance(t.get("name"), str)]
    return out


_PARSED = "content string, calls array<struct<id: string, name: string, arguments: string, refs: array<string>, raw: string>>, result_id string, tools array<struct<name: string, schema: string>>, bad string"


def _parsed(rows: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        call = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("refs", pa.list_(pa.string())), ("raw", pa.string())])
        kinds = {"content": pa.string(), "calls": pa.list_(call), "result_id": pa.string(), "tools": pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())])), "bad": pa.string()}
        for b in batches:
            got = [parse(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in (0, 1, 2, 4)), *(pa.array([g[k] for g in got], t) for k, t in kinds.items())], ["conv_id", "turn", "role", "node", *kinds])

    return in_arrow(rows, run, f"conv_id long, turn long, role string, node string, {_PARSED}")


def _valid(calls: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            args, schemas = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("arguments", "schema"))
            yield b.append_column("valid", pa.array([None if s is None or not sound(schema := json.loads(s)) else fits(json.loads(a), schema) for a, s in zip(args, schemas)], pa.bool_()))

    return in_arrow(calls, run, T.StructType([*calls.schema.fields, T.StructField("valid", T.BooleanType())]))


def _settle(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, node, order_turn, order_level, cycle) of the nodes of conversations in which an edge runs against the turns."""
    torn = edges.filter("before_turn >= after_turn").select("conv_id").distinct()
    edges = cut(edges.join(torn, "conv_id", "left_semi"), "chat-edges")
    left = nodes.join(torn, "conv_id", "left_semi").join(edges.select("conv_id", F.explode(F.array("before", "after")).alias("node")).distinct(), ["conv_id", "node"], "left_semi").select("conv_id", "node", "turn").distinct()
    left = cut(left, "chat-left")
    settled = None
    while not left.isEmpty():
        waits = edges.join(left.select("conv_id", F.col("node").alias("before")), ["conv_id", "before"], "left_semi").select("conv_id", F.col("after").alias("node"))
        ready = left.join(waits, ["conv_id", "node"], "left_anti")
        if settled is None:
            new = ready.select("conv_id", "node", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"))
        else:
            pre = edges.join(settled.select("conv_id", F.col("node").alias("before"), F.struct("order_turn", "order_level").alias("at")), ["conv_id", "before"]).groupBy("conv_id", F.col("after").alias("node")).agg(F.max("at").alias("at"))
            late = F.coalesce(F.col("at.order_turn") >= F.col("turn"), F.lit(False))
            new = ready.join(pre, ["conv_id", "node"], "left").select("conv_id", "node", F.when(late, F.col("at.order_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(late, F.col("at.order_level") + 1).otherwise(F.lit(0)).cast("long").alias("order_level"))
        new = cut(new, "chat-new")
        if new.isEmpty():
            break  # what is left is in or behind a cycle
        settled = new if settled is None else cut(settled.unionByName(new), "chat-settled")
        left = cut(left.join(new, ["conv_id", "node"], "left_anti"), "chat-left")
    rest = left.select("conv_id", "node", F.col("turn").alias("order_turn"), F.lit(0).cast("long").alias("order_level"), F.lit(True).alias("cycle"))
    return rest if settled is None else settled.withColumn("cycle", F.lit(False)).unionByName(rest)


def format_chats(conversations: DataFrame, schemas: Mapping[str, dict] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_level, n_calls, n_linked, n_valid, problems, json."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")).cast("binary")))
    parsed = cut(_parsed(rows), "chat-parsed")

    places = parsed.filter(F.size("calls") > 0).select("conv_id", "turn", "node", F.posexplode("calls").alias("place", "call")).distinct()
    calls = places.select("conv_id", "turn", "node", "place", "call.*")
    owners = calls.filter("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "node", "place")).alias("owner"))
    results = parsed.filter("result_id IS NOT NULL").select("conv_id", F.col("result_id").alias("id"), "node", "turn")
    answered = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "node")).alias("answer"))
    declared = parsed.filter(F.size("tools") > 0).select("conv_id", F.explode("tools").alias("tool")).groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.max("tool.schema").alias("own"))
    given = spark.createDataFrame([(n, canonical(s)) for n, s in (schemas or {}).items()], "name string, given string")
    linked = calls.join(owners, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left").join(declared, ["conv_id", "name"], "left").join(given, "name", "left")
    linked = _valid(linked.withColumn("schema", F.coalesce("own", "given")).drop("own", "given"))
    owns = F.coalesce(F.col("owner") == F.struct("turn", "node", "place"), F.lit(False))
    linked = linked.withColumn("linked", owns & F.col("answer").isNotNull())
    problem = F.array_compact(F.array(
        F.when(F.col("raw").isNotNull(), F.lit("bad_call")),
        F.when(F.col("raw").isNull() & F.col("owner").isNotNull() & ~owns, F.lit("duplicate_id")),
        F.when(F.col("raw").isNull() & F.col("schema").isNull(), F.lit("unknown_tool")),
        F.when(F.col("schema").isNotNull() & F.col("valid").isNull(), F.lit("bad_schema")),
        F.when(F.col("valid") == F.lit(False), F.lit("invalid_arguments")),
        F.when(F.col("raw").isNull() & owns & F.col("answer").isNull(), F.lit("no_result")),
    ))
    linked = cut(linked.withColumn("problem", problem), "chat-linked")

    first = linked.filter("linked").select("conv_id", "id", "node", "turn", "answer")
    edges = results.join(first.select("conv_id", "id", F.col("node").alias("before"), F.col("turn").alias("before_turn")), ["conv_id", "id"]).select("conv_id", "before", "before_turn", F.col("node").alias("after"), F.col("turn").alias("after_turn"))
    uses = linked.select("conv_id", F.explode("refs").alias("id"), F.col("node").alias("after"), F.col("turn").alias("after_turn")).join(first.select("conv_id", "id", F.col("answer.node").alias("before"), F.col("answer.turn").alias("before_turn")), ["conv_id", "id"]).drop("id")
    order = _settle(edges.unionByName(uses).distinct(), parsed.select("conv_id", "node", "turn"))

    own_json = F.when(F.col("raw").isNotNull(), F.concat(F.lit('{"raw":'), "raw", F.lit("}"))).otherwise(F.concat(F.lit('{"arguments":'), "arguments", F.lit(',"id":'), _quoted("id"), F.lit(',"name":'), _quoted("name"), F.lit("}")))
    by_node = linked.groupBy("node").agg(
        F.count(F.lit(1)).alias("calls_n"), F.sum(F.col("linked").cast("long")).alias("linked_n"), F.sum(F.coalesce("valid", F.lit(False)).cast("long")).alias("valid_n"), F.flatten(F.collect_list("problem")).alias("call_problems"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", own_json.alias("j")))), lambda x: x["j"]), ",").alias("calls_json"),
    )  # fmt: skip  at most the calls of one message
    known = first.select("conv_id", F.col("id").alias("result_id"), F.lit(True).alias("found"))
    out = parsed.join(by_node, "node", "left").join(known, ["conv_id", "result_id"], "left").join(order.drop("conv_id"), "node", "left")
    problems = F.array_sort(F.array_distinct(F.array_compact(F.concat(
        F.coalesce("call_problems", F.array().cast("array<string>")),
        F.array(F.col("bad"), F.when(F.col("result_id").isNotNull() & F.col("found").isNull(), F.lit("orphan_result")), F.when(F.col("cycle"), F.lit("cycle"))),
    ))))
    text = F.concat(
        F.lit('{"content":'), "content", F.lit(',"role":'), F.coalesce(_quoted("role"), F.lit("null")),
        F.when(F.col("result_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _quoted("result_id"))).otherwise(F.lit("")),
        F.when(F.col("calls_n") > 0, F.concat(F.lit(',"tool_calls":['), "calls_json", F.lit("]"))).otherwise(F.lit("")), F.lit("}"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id", "turn", "role", F.coalesce("order_turn", "turn").alias("order_turn"), zero("order_level").alias("order_level"),
        zero("calls_n").alias("n_calls"), zero("linked_n").alias("n_linked"), zero("valid_n").alias("n_valid"), F.array_join(problems, ",").alias("problems"), text.alias("json"),
    ).orderBy("conv_id", "order_turn", "order_level", "turn")


def _quoted(name: str):
    """A JSON string; identifiers, names and roles with control characters are rare, yet escaped all the same."""
    c = F.to_json(F.struct(F.col(name).alias("x")))
    return F.when(F.col(name).isNotNull(), F.substring(c, F.lit(6), F.length(c) - 6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: The tables hold no calls, results or declared tools, for which tests compare the operator with a brute-force version.
SQL = """
SELECT conv_id, turn, role, turn AS order_turn, 0::BIGINT AS order_level, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_valid, '' AS problems,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json
FROM conversations"""
