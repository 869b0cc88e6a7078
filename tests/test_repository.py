"""Commits, branches, time travel, pruned diffs, garbage collection, exchange, imports, streams, command line."""

import os
import sqlite3

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators import diff
from palimpsest.operators.chunking import Spec
from palimpsest.sources import imports, remotes, sqlite
from palimpsest.sources.commits import Commit, CommitStore, MemoryFiles, RefConflict
from palimpsest.sources.files import Files
from palimpsest.sources.repository import Repository
from palimpsest.streaming import commits as streams

SPEC = Spec(pattern=0.1, least=512, target=4096, most=16384)


def table(spark, n, change=None, gone=()):
    value = F.concat(F.lit("value "), F.col("id"), F.lit(" "), F.repeat(F.lit("x"), 40))
    rows = spark.range(n).select(F.col("id"), (F.when(F.col("id").isin(change), F.lit("changed")).otherwise(value) if change else value).alias("v"))
    return rows.where(~F.col("id").isin(list(gone))) if gone else rows


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    r = Repository.init(spark, str(tmp_path_factory.mktemp("r") / "repo"), "me", SPEC)
    d = r.draft()
    d.create_table("t", "id long, v string", ["id"])
    d.insert_rows("t", table(spark, 2000))
    d.commit("first", "me")
    d = r.draft()
    d.replace_rows("t", table(spark, 2000, change=[5, 1234], gone=[77]))
    d.set({"b": "2", "a": "1"})
    d.commit("second", "me")
    return r


def test_time_travel_and_counts(repo):
    assert repo.table("t", "HEAD~1").count() == 2000 == repo.snapshot("HEAD~1").count_rows("t")
    assert repo.table("t").count() == 1999 == repo.snapshot().count_rows("t")
    assert repo.table("t").where("v = 'changed'").count() == 2
    assert repo.snapshot("HEAD~2").list_tables() == [] and repo.snapshot().list_tables() == ["t"]


def test_prefix_order_is_that_of_strings(repo):
    got = [r["id"] for r in repo.snapshot().read_rows("t", "199").orderBy(F.col("id").cast("string")).collect()]
    assert got == [199, 1990, 1991, 1992, 1993, 1994, 1995, 1996, 1997, 1998, 1999]
    assert repo.snapshot().read_rows("t", "199", raw=True).where(F.col("value").startswith("[1990,")).count() == 1


def test_point_reads_and_entries(repo):
    snap = repo.snapshot()
    assert snap.get("a") == "1" and snap.get("/d/t/5") == '[5,"changed"]' and snap.get("/d/t/77") is None
    assert snap.get("/s/t").startswith('{"columns":["id","v"]')
    assert snap.entries("/s/").count() == 1 and snap.count() == snap.entries().count()


def test_diff_reads_only_what_is_not_shared(repo):
    n = repo.diff_stats("HEAD~1", "HEAD").first()
    assert n["leaves_skipped"] > 10 and n["old_leaves"] <= 6
    assert repo.diff("HEAD~1", "HEAD", "/d/t/").select("key").orderBy("key").collect() == [("/d/t/1234",), ("/d/t/5",), ("/d/t/77",)]
    pruned = {r["id"]: r["status"] for r in repo.row_diff("t", "HEAD~1", "HEAD").collect()}
    whole = {r["id"]: r["status"] for r in diff.row_diff(repo.table("t", "HEAD~1"), repo.table("t"), ["id"]).collect()}
    assert pruned == whole == {5: "modified", 1234: "modified", 77: "deleted"}
    assert repo.diff("HEAD", "HEAD").count() == 0


def test_last_entry_of_a_leaf_before_a_shared_one(spark, repo):
    last = sorted(r["last_key"] for r in repo.snapshot("HEAD~1").leaves("t").collect())[3].rpartition("/")[2]
    d = repo.draft("HEAD~1")
    d.insert_rows("t", spark.createDataFrame([(int(last), "edge")], "id long, v string"))
    other = d.write()
    from palimpsest.sources.repository import Snapshot

    got = repo.diff_snapshots(repo.snapshot("HEAD~1"), Snapshot(repo, other)).collect()
    assert [(r["key"], r["change_type"]) for r in got] == [(f"/d/t/{last}", "modified")]


def test_root_does_not_depend_on_history(spark, repo):
    d = repo.draft(empty=True)
    d.create_table("t", "id long, v string", ["id"])
    d.insert_rows("t", table(spark, 2000).where("id % 2 = 0"))
    d.insert_rows("t", table(spark, 2000).where("id % 2 = 1"))
    assert d.write() == repo._commit_of("HEAD~1").tree_root


def test_reads_by_key_take_few_leaves(spark, repo):
    snap = repo.snapshot()
    got = sorted(str(r["id"]) for r in snap.seek("t", "995").collect())
    assert got == sorted(str(i) for i in range(2000) if str(i) >= "995")
    leaf = snap.leaves("t").orderBy("ord").first()
    assert snap.node(leaf["leaf_hash"])["first_key"] == leaf["first_key"] and snap.node("nothing") is None
    inner = snap.edges().where("level = 1").first()["parent_hash"]
    assert not snap.node(inner)["is_leaf"] and len(snap.node(inner)["children"]) > 1
    held = snap.leaves("t").where((F.col("last_key") >= "/d/t/199") & ((F.col("first_key") <= "/d/t/199") | F.col("first_key").startswith("/d/t/199"))).count()
    assert held < snap.leaves("t").count() / 3


def test_many_writes_are_one_scan_and_nothing_is_left_behind(spark, tmp_path, repo):
    from palimpsest.sources.staging import shared_dir

    top = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top))
    r = Repository.init(spark, str(tmp_path / "many"), "me", SPEC)
    d = r.draft()
    d.create_table("t", "id long, v string", ["id"])
    d.insert_rows("t", table(spark, 600))
    d.commit("0")
    for i in range(4):
        d = r.draft()
        d.insert_rows("t", spark.createDataFrame([(i * 150, f"changed {i}")], "id long, v string"))
        d.commit(f"c{i}")
    assert len(r.files.list("data")) >= 4
    found = r.table("t")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 8
    assert found.count() == 600 and found.where("v like 'changed%'").count() == 4
    assert set(os.listdir(top)) == before


def test_diff_of_any_roots(repo):
    a, b = repo.snapshot_at(repo.snapshot("HEAD~1").root), repo.snapshot_at(repo.snapshot().root)
    assert repo.diff(a, b).count() == repo.diff("HEAD~1", "HEAD").count() > 0
    assert repo.db_diff(a, b).totals() == {"added": 0, "deleted": 1, "modified": 2}
    assert repo.db_diff(a, b).summary() == "~ table t: -1 rows, ~2 rows, columns: v"


def test_structure_is_sound(repo):
    assert repo.snapshot().problems().count() == 0
    assert {r["is_leaf"] for r in repo.snapshot().stats().collect()} == {True, False}


def test_keys_must_be_whole_and_unique(spark, repo):
    d = repo.draft()
    with pytest.raises(ValueError, match="does not exist"):
        d.insert_rows("nowhere", table(spark, 1))
    d.replace_rows("t", spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string"))
    with pytest.raises(ValueError, match="not unique"):
        d.write()


def test_refs_and_log(repo):
    assert [c.message for _, c in repo.log()] == ["second", "first", "Initial commit"]
    assert [c.message for _, c in repo.log(max_count=1)] == ["second"] and list(repo.log("nothing")) == []
    at = repo.resolve("HEAD")
    assert repo.resolve(at[:10].upper()) == at == repo.resolve("main") == repo.resolve("HEAD~0")
    assert repo.resolve("HEAD~9") is None and repo.resolve("HEAD~-1") is None and repo.resolve("") is None
    repo.create_branch("side", "HEAD~1")
    with pytest.raises(ValueError, match="exists"):
        repo.create_branch("side")
    with pytest.raises(ValueError, match="no such"):
        repo.checkout("nowhere")
    assert repo.list_branches()["side"] == repo.resolve("main~1")


def test_commonality(repo):
    n = {r["side"]: r["count"] for r in repo.commonality("HEAD~1", "HEAD").groupBy("side").count().collect()}
    assert n["both"] > 10 and n["left_only"] > 0 and n["right_only"] > 0


@pytest.mark.parametrize("files", [MemoryFiles])
def test_refs_are_compared_and_swapped(files):
    store = CommitStore(files())
    c = Commit("root", (), "m", 1234567890.0, "me")
    assert Commit.from_json(c.to_json()) == c and store.put_commit(c) == store.put_commit(c) == c.hash
    store.update_ref("main", None, c.hash)
    with pytest.raises(RefConflict) as e:
        store.update_ref("main", None, "x")
    assert e.value.actual == c.hash
    store.update_ref("main", c.hash, "y")
    assert store.get_ref("main") == "y" and store.list_refs() == {"main": "y"}
    assert store.find_by_prefix(c.hash[:6]) == c.hash and store.find_by_prefix("") is None
    with pytest.raises(ValueError):
        store.update_ref("a/b", None, "x")


def test_gc_push_pull(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path / "a"), "me", SPEC)
    for i, rows in enumerate((table(spark, 800), table(spark, 800, change=[3]))):
        d = r.draft()
        d.create_table("t", "id long, v string", ["id"])
        d.replace_rows("t", rows)
        d.commit(f"c{i}")
    there = Repository(spark, str(tmp_path / "b"))
    first = r.push(there)
    assert first["commits"] == 3 and first["leaves"] == r._index().count()
    assert there.snapshot("main").table("t").exceptAll(r.table("t")).count() == 0
    assert r.push(there) == {"commits": 0, "leaves": 0}
    # a change sends what is new and no more
    d = r.draft()
    d.insert_rows("t", spark.createDataFrame([(801, "new")], "id long, v string"))
    d.commit("c2")
    assert r.nodes_to_push("HEAD~1").count() <= 2
    assert r.push(there)["leaves"] <= 2
    with pytest.raises(ValueError):
        r.nodes_to_push("nowhere")
    # a clone, and a conflict
    there.store.set_head("main")
    clone = Repository(spark, str(tmp_path / "c"))
    assert clone.pull(there, "main")["commits"] == 4 and clone.table("t", "main").count() == 801
    d = there.draft("main")
    d.insert_rows("t", spark.createDataFrame([(900, "theirs")], "id long, v string"))
    d.commit("theirs")
    d = r.draft()
    d.insert_rows("t", spark.createDataFrame([(901, "mine")], "id long, v string"))
    d.commit("mine")
    with pytest.raises(RefConflict):
        r.push(there)
    with pytest.raises(RefConflict):
        r.pull(there)
    # nothing is garbage but what an abandoned commit alone holds
    assert r.gc(dry_run=True)["garbage"] == 0
    r.store.set_ref("main", r.resolve("HEAD~1"))
    before = r.table("t").count()
    n = r.gc()
    assert n["garbage"] > 0 and r.table("t").count() == before == 801 and r.gc()["garbage"] == 0
    assert r.gc_stats(set()).first()["reachable"] == 0 and r.gc_stats({"unknown"}).first()["garbage_pct"] == 100.0


def make_sqlite(path):
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE stations (code INTEGER PRIMARY KEY, place TEXT NOT NULL, line TEXT, height INTEGER);
        INSERT INTO stations VALUES (4,'Northgate','red',112),(9,'Mill Lane',NULL,87),(31,'Quay','blue',NULL);
        CREATE TABLE departures (station INTEGER, minute INTEGER, bound_for TEXT, fare REAL, PRIMARY KEY (station, minute));
        INSERT INTO departures VALUES (4,615,'Quay',3.25),(4,640,'Mill Lane',1.5),(9,622,'Northgate',1.5);
        CREATE TABLE remarks (note TEXT, n INTEGER);
        INSERT INTO remarks VALUES ('late', 1), ('late', 1), ('lost', 'not a number');
        CREATE TABLE unused (k INTEGER PRIMARY KEY, what TEXT);
    """)
    db.commit()
    db.close()


def test_sqlite_import(spark, tmp_path):
    path = str(tmp_path / "x.db")
    make_sqlite(path)
    r = Repository.init(spark, str(tmp_path / "repo"), "me")
    _, counts = imports.import_database(r, path)
    assert counts == {"unused": 0, "departures": 3, "remarks": 3, "stations": 3}
    snap = r.snapshot()
    assert snap.list_tables() == ["departures", "remarks", "stations"]
    assert snap.tables["departures"].primary_key == ("station", "minute") and snap.tables["departures"].declared == ("INTEGER", "INTEGER", "TEXT", "REAL")
    assert snap.get("/d/departures/4/615") == '[4,615,"Quay",3.25]' and snap.get("/d/stations/9") == '[9,"Mill Lane",null,87]'
    assert sorted(x["bound_for"] for x in snap.read_rows("departures", "4/").collect()) == ["Mill Lane", "Quay"]
    assert [tuple(x) for x in snap.table("remarks").orderBy("rowid").collect()] == [(1, "late", 1), (2, "late", 1), (3, "lost", None)]
    assert imports.sorted_problems(r, "remarks") == []
    with pytest.warns(UserWarning, match="nowhere"):
        imports.import_database(r, path, ["stations", "nowhere"])
    assert r.snapshot().list_tables() == ["stations"]
    imports.import_database(r, path, ["departures"], merge=True)
    assert r.snapshot().list_tables() == ["departures", "stations"]
    with pytest.raises(ValueError):
        sqlite.describe(path, "nowhere")


def test_remote_settings():
    got = remotes.load('[remotes.origin]\ntype = "file"\npath = "/x"')
    assert got["origin"].path == "/x"
    for bad in ('[remotes.o]\ntype="ftp"\npath="x"', '[remotes.o]\ntype="file"', '[remotes.o]\ntype="file"\npath="x"\nsecret_access_key="k"'):
        with pytest.raises(ValueError):
            remotes.load(bad)
    got = remotes.load('[remotes.a]\ntype = "s3"\nbucket = "tables"\nprefix = "/shop/"\n[remotes.b]\ntype = "s3"\nbucket = "tables"')
    assert got["a"].path == "s3a://tables/shop" and got["b"].path == "s3a://tables"
    with pytest.raises(ValueError, match="bucket"):
        remotes.load('[remotes.o]\ntype = "s3"\npath = "x"')
    with pytest.raises(ValueError):
        remotes.path_of("what")
    assert remotes.path_of("cached-file:///x") == "file:///x" and remotes.path_of(":memory:").startswith("file:///")


def test_stream_of_commits(spark, tmp_path):
    r = Repository.init(spark, str(tmp_path / "repo"), "me")
    d = r.draft()
    d.create_table("e", "id long, v string", ["id"])
    d.insert_rows("e", spark.createDataFrame([(1, "old")], "id long, v string"))
    start = d.commit("start")
    spark.createDataFrame([(1, "new", 1), (2, "x", 1), (2, "y", 2)], "id long, v string, seq int").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, v string, seq int").parquet(str(tmp_path / "in"))
    q = streams.commit_stream(source, r, "e", ["seq"], str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, r.table("e").collect())) == [(1, "new"), (2, "y")]
    # a batch that runs again commits nothing, however many commits came since
    for i in range(3):
        r.commit(r.snapshot().root, f"other {i}")
    at = r.resolve("HEAD")
    streams.committer(r, "e", ["seq"])(spark.createDataFrame([(1, "again", 9)], "id long, v string, seq int"), 0)
    assert r.resolve("HEAD") == at
    feed = streams.change_feed(r, "e", start)
    assert sorted((x["id"], x["status"]) for x in feed.collect()) == [(1, "modified"), (2, "added")]


def test_command_line(spark, tmp_path, capsys):
    repo, path = str(tmp_path / "repo"), str(tmp_path / "x.db")
    make_sqlite(path)

    def run(*args, ok=True):
        code = cli.main(["--repo", repo, "--author", "me", *args], spark)
        got = capsys.readouterr()
        assert (code == 0) == ok, got.err
        return got.out + got.err

    assert "no repository" in run("log", ok=False)
    assert "Initialized" in run("init")
    assert "there is a repository" in run("init", ok=False)
    assert "stations: 3 rows" in run("import-sqlite", path, "--tables", "stations")
    assert "Committed" in run("set", "k", "v")
    assert run("get", "k").strip() == "v" and "no such key" in run("get", "zz", ok=False)
    assert "+ k => v" in run("diff") and "1 added, 0 deleted" in run("diff", "--limit", "0")
    assert "/d/stations/4" in run("dump", "--prefix", "/d/stations/")
    assert "import" in run("log").lower() and run("log", "--max-count", "1").count("commit ") == 1
    assert "Created" in run("branch", "dev") and "* dev" in run("branch")
    assert "Switched" in run("checkout", "main")
    assert "both:" in run("commonality") and "root" in run("print-tree", "--verbose")
    assert "+ table stations (3 rows" in run("db-diff", "HEAD~2", "HEAD~1") and "no changes" in run("db-diff")
    assert "0 would be removed" in run("gc", "--dry-run")
    assert "Pushed" in run("push", str(tmp_path / "remote")) and "Pulled 0 commits" in run("pull", str(tmp_path / "remote"))


def test_exclusive_creation_by_renaming(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}")
    files.local, files.scheme = None, "hdfs"  # the way of such file systems, on this disk
    assert files.create("refs/main/0", "a") and not files.create("refs/main/0", "b")
    assert files.read("refs/main/0") == "a" and files.list("refs/main") == ["0"]
    with pytest.raises(Py4JJavaError):  # a writer that did not see the other's file
        files._rename("refs/main/0", "b", replace=False)
    files.write("HEAD", "main")
    files.write("HEAD", "dev")
    assert files.read("HEAD") == "dev" and files.list("refs/main") == ["0"]
    files.scheme = "ftp"
    with pytest.raises(NotImplementedError):
        files.create("refs/main/1", "c")


def test_cached_files_remember_commits_only(spark, tmp_path):
    files = remotes.files_of(spark, f"cached-file://{tmp_path}")
    files.create("commits/a.json", "1")
    files.create("refs/main/0", "a")
    assert files.read("commits/a.json") == "1" and files.read("refs/main/0") == "a"
    (tmp_path / "commits/a.json").unlink()
    (tmp_path / "refs/main/0").write_text("b")
    assert files.read("commits/a.json") == "1" and files.read("refs/main/0") == "b" and files.read("commits/b.json") is None
    files.delete("commits")
    files.create("commits/a.json", "2")
    files.delete("commits/a.json")
    assert files.read("commits/a.json") is None


def test_import_tells_of_its_progress(spark, tmp_path):
    path = str(tmp_path / "x.db")
    make_sqlite(path)
    told = []
    imports.import_database(Repository.init(spark, str(tmp_path / "repo"), "me"), path, progress=told.append)
    assert [(p.table, p.rows, p.all_rows) for p in told] == [("departures", 3, 3), ("remarks", 3, 6), ("stations", 3, 9), ("unused", 0, 9), ("", 9, 9)]
    assert all(p.rate >= 0 and p.all_seconds >= p.seconds >= 0 for p in told)
