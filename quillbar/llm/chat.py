"""Chat formatting: tool-call linking.

Messages carry tool calls (an id, a tool's name, arguments and, if the call needs
another's result, that call's id in ``after``) and tool results (the id they
answer). Calls and results meet in a hash join on (conversation, id), so a long
conversation is spread by its ids and never gathered. Order is topological: a node
sorts by (order_turn, depth, turn, part), where order_turn is the latest turn among
the node and what it waits for, and depth counts the steps back to a node that
waits for nothing; both come from pointer doubling, in as many joins as the
logarithm of the longest chain. Arguments are checked against the tool's schema and
every message is written as canonical JSON (sorted keys, no spaces, UTF-8).

A text that is no JSON, or is nested deeper than Python reads, is a plain message. A
call's arguments may be a JSON text of an object. Content beside calls is a message node
before them, and a list without calls leaves one, too, so no message is lost. Numbers
that JSON cannot say (NaN, infinities) are written as null and are an error; lone
surrogates are written as escapes.

Null conv_id or call id: never linked. An id used by several calls of a conversation
names the earliest; the others are not linked. A chain that returns to itself has
null depth and sorts by its own turn. Null text or payload counts as null content. Extra
columns are left out. Repeated rows are repeated in the result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

NODE = "conv_id long, turn long, part int, kind string, call_id string, name string, after string, payload string"
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def plain(text: str) -> str:
    """``text`` with lone surrogates as escapes, so that it can be encoded."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def parse(conversations: DataFrame) -> DataFrame:
    """Nodes of messages whose text is JSON: an assistant's ``tool_calls`` (id, name,
    arguments, after) and a tool's ``tool_call_id`` with ``content``. Any other
    message is a node of kind message with its text as payload."""

    def as_text(x: Any) -> str | None:
        return None if x is None else plain(str(x))

    def call(c: Any) -> tuple:
        c = c if isinstance(c, dict) else {"arguments": c}
        given = c.get("arguments")
        if isinstance(given, str):
            try:
                read = json.loads(given)
            except (ValueError, RecursionError):
                read = None
            given = read if isinstance(read, dict) else given
        return ("call", as_text(c.get("id")), as_text(c.get("name")), as_text(c.get("after")), json.dumps(given))

    def nodes(role: str | None, text: str | None) -> list[tuple]:
        try:
            body = json.loads(text) if text and text.lstrip()[:1] == "{" else None
            if role == "assistant" and isinstance(body, dict) and isinstance(body.get("tool_calls"), list):
                calls = [call(c) for c in body["tool_calls"]]
                said = body.get("content")
                return [("message", None, role, None, json.dumps(said))] * (not calls or said not in (None, "")) + calls
            if role == "tool" and isinstance(body, dict) and "tool_call_id" in body:
                return [("result", as_text(body["tool_call_id"]), None, None, json.dumps(body.get("content")))]
        except (ValueError, RecursionError):
            pass
        return [("message", None, role, None, json.dumps(text))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(c, t, p, *n) for c, t, r, x in zip(f["conv_id"], f["turn"], f["role"], f["text"], strict=True) for p, n in enumerate(nodes(r, x))]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])
            yield out.astype({"conv_id": "Int64", "turn": "Int64", "part": "int32"})

    return conversations.select("conv_id", "turn", "role", "text").mapInPandas(run, NODE)


def as_tool_chats(conversations: DataFrame) -> DataFrame:
    """Plain chats (conv_id, turn, role, text) as chats with tools, a message a turn.

    A user's turn t becomes an assistant's call "t.0" of ``search``, which waits for
    that of two turns before; a text of over 200 characters also calls ``look``, "t.1",
    which waits for "t.0" (it repeats that id where the length is a multiple of 11). A
    limit is a string where the length is a multiple of 5, and ``how`` is one of three
    words of which the schema knows two, so some arguments are wrong. An assistant's turn
    becomes the result of the turn before: of its first call, or where the text's length
    is a multiple of 3 of its second, which may not exist. Other turns stay.
    """
    role, turn, text = F.col("role"), F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    n = F.length(text)
    name = lambda t, part: F.concat(t.cast("string"), F.lit(part))

    def call(id_: Column, tool: str, after: Column, **arguments: Column) -> Column:
        given = F.struct(*[v.alias(k) for k, v in arguments.items()])
        return F.to_json(F.struct(id_.alias("id"), F.lit(tool).alias("name"), given.alias("arguments"), after.alias("after")))

    before = F.when(turn >= 2, name(turn - 2, ".0"))
    right, wrong = (call(name(turn, ".0"), "search", before, query=text, limit=limit) for limit in (n % 7, (n % 7).cast("string")))
    how = F.element_at(F.array(F.lit("exact"), F.lit("near"), F.lit("loose")), n % 3 + 1)
    second = call(F.when(n % 11 == 0, name(turn, ".0")).otherwise(name(turn, ".1")), "look", name(turn, ".0"), how=how)
    calls = F.concat_ws(",", F.when(n % 5 == 0, wrong).otherwise(right), F.when(n > 200, second))
    result = F.to_json(F.struct(F.when(n % 3 == 0, name(turn - 1, ".1")).otherwise(name(turn - 1, ".0")).alias("tool_call_id"), text.alias("content")))
    user, assistant = F.coalesce(role == "user", F.lit(False)) & turn.isNotNull(), F.coalesce(role == "assistant", F.lit(False)) & turn.isNotNull()
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        turn.alias("turn"),
        F.when(user, "assistant").when(assistant, "tool").otherwise(role).alias("role"),
        F.when(user, F.concat(F.lit('{"tool_calls":['), calls, F.lit("]}"))).when(assistant, result).otherwise(F.col("text")).alias("text"),
    )


def violations(arguments: Any, schema: dict[str, Any] | None) -> list[str]:
    """What is wrong with ``arguments``: types, required, unknown and enum."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    known = schema.get("properties", {})
    found = [f"{k}: missing" for k in schema.get("required", []) if k not in arguments]
    for k, v in arguments.items():
        rule = known.get(k)
        if rule is None:
            if not schema.get("additionalProperties", True):
                found.append(f"{k}: unknown")
            continue
        kind = rule.get("type")
        if kind and (not isinstance(v, TYPES[kind]) or (isinstance(v, bool) and kind in ("integer", "number"))):
            found.append(f"{k}: no {kind}")
        elif "enum" in rule and v not in rule["enum"]:
            found.append(f"{k}: not allowed")
    return sorted(found)


def finite(value: Any) -> tuple[Any, bool]:
    """``value`` with null for every number that JSON cannot say; whether there is one."""
    if isinstance(value, float) and not math.isfinite(value):
        return None, True
    if isinstance(value, list):
        made = [finite(v) for v in value]
        return [v for v, _ in made], any(x for _, x in made)
    if isinstance(value, dict):
        made = {k: finite(v) for k, v in value.items()}
        return {k: v for k, (v, _) in made.items()}, any(x for _, x in made.values())
    return value, False


def canonical(value: Any) -> str:
    return plain(json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")))


def written(kind: str, call_id: str | None, name: str | None, after: str | None, payload: str | None, schemas: dict[str, dict[str, Any]]) -> tuple[list[str], str | None]:
    """What is wrong with a node, and its canonical JSON (null if it cannot be written)."""
    try:
        value, odd = finite(json.loads(payload) if isinstance(payload, str) else None)
        wrong = violations(value, schemas.get(name)) if kind == "call" else []
        if kind == "call":
            body = {"arguments": value, "id": call_id, "name": name, "role": "assistant"} | ({"after": after} if after else {})
        elif kind == "result":
            body = {"content": value, "role": "tool", "tool_call_id": call_id}
        else:
            body = {"content": value, "role": name}
        return wrong + ["not a finite number"] * odd, canonical(body)
    except RecursionError:
        return ["nested too deeply"], None


def link(nodes: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """Every node with linked, order_turn, depth, valid, errors and json."""
    nodes = cut(nodes.select(*[c.split()[0] for c in NODE.split(", ")]))
    found = nodes.where("kind = 'call' and conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "part", "after")).alias("c"))
    answered = nodes.where("kind = 'result' and conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    # reach: the latest turn among the call and what it waits for; hop: the next call to look at
    calls = cut(found.select("conv_id", "call_id", F.col("c.turn").alias("turn"), F.col("c.part").alias("part"), F.col("c.turn").alias("reach"), F.lit(0).cast("long").alias("steps"), F.col("c.after").alias("hop")))
    for _ in range(calls.count().bit_length() + 1):  # no chain is longer than there are calls; loops are left
        if calls.where("hop is not null").isEmpty():
            break
        there = calls.select("conv_id", F.col("call_id").alias("hop"), F.col("reach").alias("r2"), F.col("steps").alias("s2"), F.col("hop").alias("h2"))
        calls = cut(calls.join(there, ["conv_id", "hop"], "left").select("conv_id", "call_id", "turn", "part", F.greatest("reach", "r2").alias("reach"), F.when(F.col("s2").isNull(), F.col("steps")).otherwise(F.least(F.col("steps") + F.col("s2") + 1, F.lit(1 << 40))).alias("steps"), F.col("h2").alias("hop")))
    loop = F.col("hop").isNotNull()
    calls = calls.join(answered, ["conv_id", "call_id"], "left").select(
        F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), F.col("turn").alias("_t"), F.col("part").alias("_p"), F.when(~loop, F.col("reach")).otherwise(F.col("turn")).alias("reach"), F.when(~loop, 2 * F.col("steps")).alias("steps"), (F.coalesce("answers", F.lit(0)) > 0).alias("answered")
    )
    both = nodes.join(calls, (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_k")), "left")
    named = F.col("_k").isNotNull() & F.when(F.col("kind") == "call", F.col("turn").eqNullSafe(F.col("_t")) & (F.col("part") == F.col("_p"))).otherwise(F.col("kind") == "result")
    result = F.col("kind") == "result"
    rows = both.select(
        *nodes.columns,
        (named & F.when(result, True).otherwise(F.coalesce("answered", F.lit(False)))).alias("linked"),
        F.when(named, F.greatest("turn", "reach")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(named, F.col("steps") + F.when(result, 1).otherwise(0)).otherwise(0).cast("long").alias("depth"),
    )
    schema = "conv_id long, turn long, part int, kind string, call_id string, linked boolean, order_turn long, depth long, valid boolean, errors string, json string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [written(*node, schemas) for node in zip(f["kind"], f["call_id"], f["name"], f["after"], f["payload"], strict=True)]
            wrong = ["; ".join(w) for w, _ in made]
            out = f[["conv_id", "turn", "part", "kind", "call_id", "linked", "order_turn", "depth"]].copy()
            yield out.assign(valid=[not w for w in wrong], errors=wrong, json=[j for _, j in made]).astype({c: "Int64" for c in ("conv_id", "turn", "order_turn", "depth")})

    return rows.mapInPandas(run, schema)


#: The tools of ``as_tool_chats``.
TOOLS = {
    "search": {"properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query", "limit"], "additionalProperties": False},
    "look": {"properties": {"how": {"type": "string", "enum": ["exact", "near"]}}, "required": ["how"], "additionalProperties": False},
}
