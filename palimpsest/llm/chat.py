"""Chat formatting with linked tool calls.

Messages are rows (conv_id, turn, role, text). A message whose text is a JSON object with
``tool_calls`` (each with ``id``, ``name``, ``arguments`` and, optionally, ``after``: ids of calls
whose results it needs) holds calls; a message of role ``tool`` is a result, either a JSON object
with ``tool_call_id`` and ``content`` or plain text without an id. Calls and results meet in a hash
join on (conversation, id). Arguments are validated against the tool's schema.

Order: by turn, then place in the message. A result that was logged before its call moves behind it,
and a call behind the results it needs, until no edge is violated. A well-formed log takes one look; of
a conversation that violates an edge, one task orders the edges (numbers only, no texts), however long
their chains. Calls that need one another, directly or through others, have status ``cycle``; they and
their results stay at their turns.

Every item is one line of canonical JSON: keys in code point order, no white space, no escapes but
those JSON demands. Conversations are never gathered: positions come from counts of runs of turns,
so one conversation may hold any share of the rows.

Null conversations are one conversation; null turns count as -1; null roles and texts as empty. Of
several calls or results with one id the first counts, the others have status ``repeated``; of rows
that repeat, each is an item. Messages of one turn come in the order of a hash of role and text, so the
result doesn't hang on the files' order. A long text is one item of one row throughout. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common, shingles

RUN = 256

Schema = dict[str, Any]
_TYPES: dict[str, Callable[[Any], bool]] = {
    "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "boolean": lambda x: isinstance(x, bool),
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "null": lambda x: x is None,
}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problem(value: Any, schema: Schema, at: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, minimum, maximum, minLength, maxLength, properties, required, additionalProperties, items); None if there is none."""
    kinds = schema.get("type")
    if kinds and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{at}: not of type {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if _TYPES["number"](value):
        if value < schema.get("minimum", value):
            return f"{at}: under minimum"
        if value > schema.get("maximum", value):
            return f"{at}: over maximum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", len(value)):
            return f"{at}: too long"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            inner = known.get(name, schema.get("additionalProperties", True))
            if inner is False:
                return f"{at}.{name}: not allowed"
            if isinstance(inner, dict) and (found := problem(value[name], inner, f"{at}.{name}")):
                return found
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := problem(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def _items(role: str, text: str, tools: dict[str, Schema]) -> list[dict]:
    """The items of a message: itself, its calls, or a result."""
    if role == "tool":
        parsed = _object(text)
        named = parsed if parsed and "tool_call_id" in parsed else {"content": text}
        call_id = named.get("tool_call_id")
        body = {"content": named.get("content"), "role": role} | ({"tool_call_id": call_id} if call_id is not None else {})
        return [{"kind": "result", "call_id": None if call_id is None else str(call_id), "body": body}]
    parsed = _object(text) if text.lstrip().startswith("{") else None
    if not parsed or not isinstance(parsed.get("tool_calls"), list):
        return [{"kind": "message", "body": {"content": text, "role": role}}]
    out = [{"kind": "message", "body": {"content": parsed["content"], "role": role}}] if parsed.get("content") else []
    for call in parsed["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        name, arguments = str(call.get("name", "")), call.get("arguments", {})
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except ValueError:
                pass
        wrong = "no such tool" if name not in tools else problem(arguments, tools[name])
        call_id = call.get("id")
        after = call.get("after") or []
        out.append({"kind": "call", "call_id": None if call_id is None else str(call_id), "after": [str(a) for a in after] if isinstance(after, list) else [], "error": wrong, "body": {"arguments": arguments, "id": call_id, "name": name, "role": role}})
    return out


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


_ITEMS = T.StructType([T.StructField(n, t) for n, t in (("place", T.IntegerType()), ("kind", T.StringType()), ("call_id", T.StringType()), ("after", T.ArrayType(T.StringType())), ("error", T.StringType()), ("json", T.StringType()))])


def items(messages: DataFrame, tools: dict[str, Schema], *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each message without calls, call, and result: conv_id, turn, tie (what orders messages of one turn), role, place, kind, call_id, after, error, json."""
    src = common.only(messages, conv_id=conv_col, turn=F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit(-1)), role=F.coalesce(F.col(f"`{role_col}`"), F.lit("")), text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    src = src.select("conv_id", "turn", F.xxhash64("role", "text").alias("tie"), "role", "text")

    def make() -> Callable:
        def step(batch: pa.RecordBatch):
            for part in shingles.slices(batch, (4,)):
                yield split_up(part)

        def split_up(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, rows = [], []
            for i, (role, text) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                for place, item in enumerate(_items(role, text, tools)):
                    owner.append(i)
                    rows.append((place, item["kind"], item.get("call_id"), item.get("after", []), item.get("error"), canonical(item["body"])))
            kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            at = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in range(4)] + [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["conv_id", "turn", "tie", "role", *_ITEMS.names])

        return step

    return common.map_rows(src, make, T.StructType([*src.drop("text").schema.fields, *_ITEMS.fields]))


def cyclic(after: dict[int, list[int]]) -> set[int]:
    """Nodes of a graph that reach themselves: those of components with several nodes or a loop (Tarjan's algorithm, without recursion)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    out: set[int] = set()
    for root in list(after):
        work = [] if root in index else [(root, iter(after[root]))]
        if work:
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
        while work:
            node, more = work[-1]
            for other in more:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(after.get(other, ()))))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = stack.index(node) if stack[-1] != node else len(stack) - 1
                    found = stack[at:]
                    del stack[at:]
                    on.difference_update(found)
                    if len(found) > 1 or node in after.get(node, ()):
                        out.update(found)
    return out


Key = tuple[int, int, int, int, int]
#: An item's own key: its message's turn and tie, its place there; then steps behind that, and the row.
PLACED = ("turn", "tie", "place")


def ordered(edges: list[tuple[int, int]], own: dict[int, Key]) -> tuple[dict[int, Key], set[int]]:
    """Keys of the nodes that edges move, and the nodes on cycles, which don't move. A moved node comes right behind the last it needs."""
    after: dict[int, list[int]] = defaultdict(list)
    for before, later in edges:
        after[before].append(later)
    loops = cyclic(after)
    open_ = dict.fromkeys(own, 0)
    for before, later in edges:
        open_[later] += later not in loops
    keys, last = dict(own), dict[int, Key]()
    ready = [n for n in own if not open_[n]]
    while ready:
        node = ready.pop()
        if node in last and last[node] >= own[node]:
            *place, step, _ = last[node]
            keys[node] = (*place, step + 1, node)
        for later in after.get(node, ()):
            if later not in loops:
                last[later] = max(last.get(later, keys[node]), keys[node])
                open_[later] -= 1
                if not open_[later]:
                    ready.append(later)
    return {n: k for n, k in keys.items() if k != own[n]}, loops


def _reorder(rows: pd.DataFrame) -> pd.DataFrame:
    """A conversation's edges to its moved items and those on cycles."""
    own: dict[int, Key] = {}
    for end in ("before", "later"):
        own |= {r: (*at, 0, r) for r, *at in zip(rows[end].tolist(), *(rows[f"{end}_{c}"].tolist() for c in PLACED), strict=True)}
    moved, loops = ordered(list(zip(rows["before"].tolist(), rows["later"].tolist(), strict=True)), own)
    found = [(n, n in loops, *moved.get(n, own[n])[:4]) for n in sorted(moved.keys() | loops)]
    return pd.DataFrame(found, columns=["row", "cycle", *(f"m_{c}" for c in PLACED), "m_step"])


def link(messages: DataFrame, tools: dict[str, Schema], **columns: str) -> DataFrame:
    """All items in order: conv_id, position (from 0), turn, role, kind, call_id, status, valid, error, json.

    status: ``message``; of calls ``linked``, ``unanswered``, ``cycle`` or ``repeated``; of results
    ``linked``, ``orphan`` or ``repeated``. valid: of calls, whether name and arguments fit; else null.
    """
    found = items(messages, tools, **columns).withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    found = common.stage(found.withColumn("row", F.monotonically_increasing_id()), "items")
    ids = found.where(F.col("call_id").isNotNull()).select("conv", "call_id", "kind", "row", *PLACED)
    ends = ids.groupBy("conv", "call_id").agg(*[F.min(F.when(F.col("kind") == k, F.struct(*PLACED, "row"))).alias(k) for k in ("call", "result")])
    ends = common.stage(ends.select("conv", "call_id", F.col("call.row").alias("call_row"), F.col("result.row").alias("result_row")), "links")

    # edges between items: a call to its result, and the results a call needs to it
    calls = found.where((F.col("kind") == "call") & F.col("call_id").isNotNull()).select("conv", "call_id", "row", F.explode("after").alias("needed"))
    needs = calls.join(ends.select("conv", F.col("call_id").alias("needed"), F.coalesce("result_row", "call_row").alias("before")), ["conv", "needed"]).select("conv", "before", F.col("row").alias("later"))
    answers = ends.where("call_row is not null and result_row is not null").select("conv", F.col("call_row").alias("before"), F.col("result_row").alias("later"))
    edges = answers.unionByName(needs).where("before is not null").distinct()

    for end in ("before", "later"):
        edges = edges.join(found.select(F.col("row").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in PLACED]), end)
    edges = common.stage(edges, "edges")
    key_of = lambda end: F.struct(*[F.col(f"{end}_{c}").alias(c) for c in PLACED], F.col(end).alias("row"))
    late = edges.where(key_of("later") <= key_of("before"))
    late = common.stage(late.select("conv").distinct(), "late")
    moved = edges.join(late, "conv", "left_semi").groupBy("conv").applyInPandas(_reorder, "row long, cycle boolean, m_turn long, m_tie long, m_place int, m_step int")
    moved = common.stage(moved, "moved").select("row", "cycle", F.struct(*[F.col(f"m_{c}").alias(c) for c in (*PLACED, "step")], "row").alias("key"))

    marks = ends.select(F.explode(F.array(F.struct(F.col("call_row").alias("row"), F.col("result_row").isNotNull().alias("met")), F.struct(F.col("result_row").alias("row"), F.col("call_row").isNotNull().alias("met")))).alias("m")).select("m.row", "m.met").where("row is not null")
    rows = found.join(marks, "row", "left").join(moved, "row", "left")
    status = (
        F.when(F.col("kind") == "message", "message")
        .when(F.col("cycle") & (F.col("kind") == "call"), "cycle")
        .when(F.col("call_id").isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
        .when(F.col("met").isNull(), "repeated")
        .when(F.col("met"), "linked")
        .otherwise(F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
    )
    own = F.struct(*PLACED, F.lit(0).alias("step"), "row")
    rows = rows.withColumn("status", status).withColumn("key", F.coalesce("key", own)).withColumn("run", F.floor(F.col("key.turn") / RUN))
    rows = common.stage(rows, "linked")

    runs = rows.groupBy("conv", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(runs.select("conv", "run", before.alias("before")), ["conv", "run"])
    place = F.row_number().over(Window.partitionBy("conv", "run").orderBy("key")) - 1 + F.col("before")
    valid = F.when(F.col("kind") == "call", F.col("error").isNull())
    return rows.select("conv_id", place.cast("long").alias("position"), "turn", "role", "kind", "call_id", "status", valid.alias("valid"), "error", "json")


#: The tool that ``as_tool_traffic`` calls.
RESPOND: dict[str, Schema] = {
    "respond": {
        "type": "object",
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}


#: How ``as_tool_traffic`` logs a conversation, by its id modulo the number of kinds; the other ids are in order.
KINDS, LATE_CALLS, REVERSED, CYCLIC = 8, 1, 2, 3


def as_tool_traffic(messages: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic, row by row: a user's turn t is a call of ``respond``, logged at 2 t; an assistant's turn is the result for the turn before it.

    Kinds of logs: in order, each call needing the one two turns before; ``LATE_CALLS``: each result is
    logged just before its call; ``REVERSED``: each call needs the one two turns later; ``CYCLIC``:
    each needs both.
    """
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    kind = F.coalesce(F.pmod(F.col("conv_id").cast("long"), F.lit(KINDS)), F.lit(0))
    quoted = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("v")))
    value = F.expr("substring(q, 6, length(q) - 6)")
    text = lambda c: c.cast("string")
    earlier, later = text(F.col("t") - 2), text(F.col("t") + 2)
    needs = F.when(F.col("kind") == REVERSED, later).when(F.col("kind") == CYCLIC, F.concat(earlier, F.lit('","'), later)).otherwise(earlier)
    call = F.concat(F.lit('{"tool_calls":[{"id":"'), text(F.col("t")), F.lit('","name":"respond","after":["'), needs, F.lit('"],"arguments":{"turn":'), text(F.col("t")), F.lit(',"prompt":'), value, F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"'), text(F.col("t") - 1), F.lit('","content":'), value, F.lit("}"))
    logged = 2 * F.col("t") - F.when((F.col("kind") == LATE_CALLS) & (F.col("role") == "assistant"), 3).otherwise(0)
    rows = messages.select("conv_id", turn.alias("t"), "role", "text", quoted.alias("q"), kind.alias("kind"))
    return rows.select("conv_id", logged.alias("turn"), F.when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))
