"""Diffs, upserts, scans, statistics and checks, on small hand-written tables."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keys
from palimpsest.operators import diff, graph, scans, stats, upsert, validate


def kv(spark, entries):
    return spark.createDataFrame([(str(k), v) for k, v in entries], "key string, value string")


def events(frame):
    return [(r["change_type"][0].upper(), r["key"], r["old_value"], r["new_value"]) for r in scans.ordered(frame).collect()]


def test_mixed_changes(spark):
    old, new = kv(spark, [(1, "a"), (2, "b"), (3, "c"), (5, "e")]), kv(spark, [(1, "A"), (2, "b"), (4, "d"), (5, "e")])
    assert events(diff.kv_diff(old, new)) == [("M", "1", "a", "A"), ("D", "3", "c", None), ("A", "4", None, "d")]
    assert diff.summary(diff.kv_diff(old, new)).first().asDict() == {"added": 1, "deleted": 1, "modified": 1, "total": 3}


def test_empty_sides_and_null_values(spark):
    some, none = kv(spark, [(1, "a"), (2, None)]), kv(spark, [])
    assert events(diff.kv_diff(none, some)) == [("A", "1", None, "a"), ("A", "2", None, None)]
    assert events(diff.kv_diff(some, none)) == [("D", "1", "a", None), ("D", "2", None, None)]
    assert events(diff.kv_diff(some, some)) == []
    assert events(diff.kv_diff(kv(spark, [(2, None)]), kv(spark, [(2, "")]))) == [("M", "2", None, "")]


def test_prefix_diff_is_the_filtered_diff(spark):
    old, new = kv(spark, [("b", "x")] + [(f"a{i}", "o") for i in range(30)]), kv(spark, [("b", "x")] + [(f"c{i}", "n") for i in range(30)])
    whole = events(diff.kv_diff(old, new))
    assert len(whole) == 60 and not any(e[1] == "b" for e in whole)
    assert events(diff.kv_diff(old, new, "c1")) == [e for e in whole if e[1].startswith("c1")]


def test_rows_compare_by_type_with_nan_and_null(spark):
    kind = "id int, x double, s string"
    old = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "a"), (3, 2.0, "b")], kind)
    new = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, None), (4, 0.0, "c")], kind)
    got = {r["id"]: (r["status"], r["changed_columns"]) for r in diff.row_diff(old, new, ["id"]).collect()}
    assert got == {2: ("modified", ["s"]), 3: ("deleted", []), 4: ("added", [])}


def test_schema_rules(spark):
    old = spark.createDataFrame([(1, 2)], "id int, a int")
    wider = old.withColumn("b", F.lit(1))
    t = diff.table_diff("t", old, wider, ["id"], ["id"])
    assert t.schema.columns_differ and t.rows.count() == 0 and t.summary() == "schema changed"
    retyped = spark.createDataFrame([(1, 3)], "id int, a bigint")
    t = diff.table_diff("t", old, retyped, ["id"], ["id"])
    assert t.schema.types_differ and t.counts()["modified"] == 1
    assert t.summary() == "schema changed, ~1 rows, columns: a"


def test_database_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(1, "z"), (2, "y")], "id int, v string")
    d = diff.db_diff({"t": (a, ["id"]), "gone": (a, ["id"])}, {"t": (b, ["id"]), "came": (a, ["id"])})
    assert (d.added, d.removed, list(d.changed())) == (["came"], ["gone"], ["t"])
    assert d.totals() == {"added": 0, "deleted": 0, "modified": 1}
    assert not diff.db_diff({"t": (a, ["id"])}, {"t": (a, ["id"])}, []).has_changes


def test_upsert_and_last_wins(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    last = upsert.last_wins(batch, ["k"], ["seq"]).drop("seq")
    assert sorted(map(tuple, upsert.upsert(base, last, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert upsert.batch_stats(base, last, ["k"]).first().asDict() == {"rows": 2, "replaced": 1, "inserted": 1}


def test_keys(spark):
    row = spark.createDataFrame([(7, "a/b", None)], "i int, s string, n string")
    got = row.select(keys.row_key("t", ["i", "s"]).alias("k"), keys.pk_text(["i", "n"]).alias("none"), keys.row_json(["i", "s", "n"]).alias("j")).first()
    assert tuple(got) == ("/d/t/7/a/b", None, '[7,"a/b",null]')
    assert spark.createDataFrame([("/d/t/7/a/b",)], "k string").select(keys.table_of_row_key(F.col("k")), keys.pk_of_row_key(F.col("k"))).first() == ("t", "7/a/b")
    with pytest.raises(ValueError):
        keys.row_key("a/b", ["i"])


def test_prefix_filter_reaches_the_scan(spark, tmp_path):
    kv(spark, [(f"{i:04d}", "v") for i in range(100)]).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    plan = scans.prefix(rows, "005")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith" in plan
    assert scans.prefix(rows, "005").count() == 10 and scans.seek(rows, "0050").count() == 50
    assert scans.seek(rows, "9999").count() == 0 and scans.point(rows, "0007").count() == 1


def test_histogram(spark):
    sizes = spark.createDataFrame([(i,) for i in [1, 2, 3, 10, 25]], "size long")
    got = stats.histogram(sizes).orderBy("lo").collect()
    assert sum(r["n"] for r in got) == 5 and got[0]["label"] == "1-2" and abs(sum(r["pct"] for r in got) - 100) < 1e-9
    assert stats.size_stats(sizes.limit(0)).first()["average"] == 0.0
    assert stats.histogram(sizes.limit(0)).count() == 0


def test_order_checks(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "c"), (2, "b"), (3, "b")], "ord int, key string")
    assert [(r["key"], r["problem"]) for r in validate.out_of_order(rows).orderBy("ord").collect()] == [("b", "out of order"), ("b", "duplicate")]
    assert validate.duplicates(rows, ["key"]).collect()[0].asDict() == {"key": "b", "n": 2}


def test_closures(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "x"), ("b", "x"), ("x", "r2"), ("q", "y")], "parent string, child string")
    root = spark.createDataFrame([("r",), ("nowhere",)], "node string")
    nodes = spark.createDataFrame([(c,) for c in ["r", "a", "b", "x", "q", "y"]], "node string")
    live = graph.reachable(edges, root, missing=nodes)
    assert sorted(r[0] for r in live.collect()) == ["a", "b", "r", "x"]
    assert sorted(r[0] for r in graph.garbage(nodes, live).collect()) == ["q", "y"]
    assert graph.gc_stats(nodes.limit(0), live.limit(0)).first().asDict() == {"total": 0, "reachable": 0, "garbage": 0, "reachable_pct": 0.0, "garbage_pct": 0.0}
    sides = graph.commonality(nodes, live)
    assert graph.commonality_totals(sides).first()["both"] == 4


def test_walk_keeps_children_before_newer_parents():
    commits = {"c": (3.0, ["b", "a"]), "b": (9.0, ["a"]), "a": (1.0, ["gone"])}
    assert list(graph.walk(["c"], commits.get)) == ["c", "b", "a"]
