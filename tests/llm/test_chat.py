import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import chat

TOOLS = {"add": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer", "minimum": 0}}, "required": ["a", "b"], "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c, strict=False)) for c in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def linked(spark, rows):
    frame = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), TOOLS)
    assert frame.columns == ["conv_id", "position", "turn", "role", "kind", "call_id", "status", "valid", "error", "json"]
    return sorted(frame.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"], r["position"]))


def test_links_order_and_validity(spark):
    rows = linked(spark, [
        (1, 0, "user", "what is 1+2?"),
        (1, 1, "tool", result("x", 3)),  # logged before its call
        (1, 2, "assistant", call(("x", "add", {"b": 2, "a": 1}), ("y", "add", {"a": "1", "b": 2}), ("z", "sub", {}))),
        (1, 3, "tool", result("y", None)),
        (1, 4, "tool", result("nobody", 1)),
        (1, 5, "tool", "no id"),
        (2, 0, "assistant", call(("x", "add", '{"a":1,"b":-1}'))),
    ])
    assert [(r["kind"], r["call_id"], r["status"]) for r in rows] == [
        ("message", None, "message"), ("call", "x", "linked"), ("result", "x", "linked"), ("call", "y", "linked"), ("call", "z", "unanswered"),
        ("result", "y", "linked"), ("result", "nobody", "orphan"), ("result", None, "orphan"), ("call", "x", "unanswered"),
    ]
    assert [r["position"] for r in rows] == [*range(8), 0]
    assert rows[1]["json"] == '{"arguments":{"a":1,"b":2},"id":"x","name":"add","role":"assistant"}' and rows[1]["valid"]
    assert [r["error"] for r in rows if r["kind"] == "call"] == [None, "$.a: not of type integer", "no such tool", "$.b: under minimum"]


def test_needed_results_come_first_and_cycles_are_told(spark):
    rows = linked(spark, [
        (1, 0, "assistant", call(("b", "add", {"a": 1, "b": 1}, ["a"]))),
        (1, 1, "assistant", call(("a", "add", {"a": 1, "b": 1}))),
        (1, 2, "tool", result("a", 2)),
        (1, 3, "tool", result("b", 2)),
    ])
    assert [(r["kind"], r["call_id"]) for r in rows] == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    rows = linked(spark, [(1, 0, "assistant", call(("b", "add", {}, ["a"]), ("a", "add", {}, ["b"])))])
    assert [r["status"] for r in rows] == ["cycle", "cycle"]


def test_odd_rows(spark):
    rows = linked(spark, [
        (None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 1, "assistant", '{"tool_calls": [17, {"id": 1}]}'),
        (1, 2, "user", "{not json"), (1, 3, "assistant", call(("d", "add", {}), ("d", "add", {}))), (1, 4, "assistant", '{"a": 1}'),
    ])
    assert len(rows) == 9 and [r["position"] for r in rows if r["conv_id"] == 1] == list(range(8))
    assert [r["status"] for r in rows if r["call_id"] == "d"] == ["unanswered", "repeated"]
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), TOOLS).count() == 0


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 16)
    rows = linked(spark, [(1, t, "user", f"m{t}") for t in range(500)])
    assert [r["position"] for r in rows] == list(range(500)) == [r["turn"] for r in rows]


@pytest.mark.parametrize(("value", "schema", "want"), [
    ({"a": [1, "x"]}, {"properties": {"a": {"type": "array", "items": {"type": "integer"}}}}, "$.a[1]: not of type integer"),
    (True, {"type": "integer"}, "$: not of type integer"), (5, {"enum": [1, 2]}, "$: not in enum"), ("ab", {"maxLength": 1}, "$: too long"),
    (9, {"maximum": 8}, "$: over maximum"), ({"x": 1}, {"required": ["y"]}, "$.y: missing"), (None, {"type": ["null", "string"]}, None),
])
def test_schemas(value, schema, want):
    assert chat.problem(value, schema) == want


def test_canonical_json_is_stable():
    assert chat.canonical({"b": [1, {"d": "é", "c": None}], "a": "\n"}) == '{"a":"\\n","b":[1,{"c":null,"d":"é"}]}'


def test_long_chains_are_ordered_and_only_cycles_are_told(spark):
    n = 300  # each call needs the one logged after it, and results come before their calls
    rows = [(1, 2 * i + k, "tool", result(str(i), i)) if k == 0 else (1, 2 * i + k, "assistant", call((str(i), "add", {"a": 1, "b": 1}, [str(i + 1)]))) for i in range(n) for k in (0, 1)]
    got = linked(spark, rows)
    assert [(r["kind"], r["call_id"]) for r in got] == [(k, str(i)) for i in reversed(range(n)) for k in ("call", "result")]
    assert {r["status"] for r in got} == {"linked"}
    # a and b need each other, s itself; d needs b, c needs d and was logged before; u is needed by a
    rows = [
        (1, 0, "assistant", call(("c", "add", {}, ["d"]))), (1, 1, "assistant", call(("a", "add", {}, ["b", "u"]))), (1, 2, "assistant", call(("b", "add", {}, ["a"]))), (1, 3, "tool", result("a", 1)),
        (1, 4, "assistant", call(("d", "add", {}, ["b"]), ("s", "add", {}, ["s"]))), (1, 5, "assistant", call(("u", "add", {}))),
    ]
    assert [(r["call_id"], r["kind"], r["status"]) for r in linked(spark, rows)] == [
        ("a", "call", "cycle"), ("b", "call", "cycle"), ("a", "result", "linked"), ("d", "call", "unanswered"), ("c", "call", "unanswered"), ("s", "call", "cycle"), ("u", "call", "unanswered"),
    ]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=25))
def test_order_and_cycles_against_brute_force(n, pairs):
    """Cycles are what reaches itself; every other edge holds in the end; what no edge violates stays."""
    edges = sorted({(a, b) for a, b in pairs if a < n and b < n})
    own = {i: (i, 0, 0, 0, i) for i in {x for e in edges for x in e}}
    moved, loops = chat.ordered(edges, own)
    reach = {a: {b for x, b in edges if x == a} for a in own}
    for _ in own:
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    assert loops == {a for a in own if a in reach[a]}
    keys = own | moved
    assert all(keys[a] < keys[b] for a, b in edges if b not in loops) and not moved.keys() & loops
    if all(own[a] < own[b] for a, b in edges):
        assert not moved


def test_ties_do_not_hang_on_the_order_of_rows(spark):
    rows = [(1, None, "user", f"m{i}") for i in range(30)] + [(1, None, "tool", result("x", i)) for i in range(3)] + [(1, None, "assistant", call(("x", "add", {"a": 1, "b": 2})))]
    plain = lambda rs: [(r["position"], r["status"], r["json"]) for r in linked(spark, rs)]
    assert plain(rows) == plain(rows[::-1])


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "w " * 200_000, 5, "x", "y"), (1, 1, "user", "short", 6, "x", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, row long, key string, json string")
    got = chat.link(frame, TOOLS).orderBy("position").collect()
    assert [len(json.loads(r["json"])["content"]) for r in got] == [400_000, 5]
