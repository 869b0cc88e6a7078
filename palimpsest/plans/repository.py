"""Repositories made from the driver's tables, for the registered queries; made once a session and folder."""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Callable
from contextlib import closing
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.operators.chunking import Spec
from palimpsest.sources.commits import Commit
from palimpsest.sources.imports import import_database
from palimpsest.sources.repository import Repository
from palimpsest.sources.staging import shared_dir

#: Chunks so small that the smallest tables have many.
SMALL = Spec(pattern=0.05, least=256, target=2048, most=8192)
TALK = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())])
KEYS = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "supplier": "s_suppkey"}
_made: dict[tuple, Any] = {}


def _once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], Any]) -> Any:
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def new(spark: SparkSession, spec: Spec | None = None) -> Repository:
    return Repository.init(spark, f"{shared_dir(spark)}/repo-{uuid.uuid4().hex}", spec=spec or Spec(pattern=0.05))


def two_commits(spark: SparkSession, old: DataFrame, new_rows: DataFrame, sf_dir: str = "", name: str = "customer", key: str = "c_custkey") -> Repository:
    def make() -> Repository:
        repo = new(spark)
        for rows, message in ((old, "old"), (new_rows, "new")):
            draft = repo.draft()
            draft.create_table(name, rows.schema, [key])
            draft.replace_rows(name, rows)
            draft.commit(message)
        return repo

    return _once(spark, f"two commits of {name}", sf_dir, make) if sf_dir else make()


def history(spark: SparkSession, sf_dir: str) -> tuple[Repository, list[str]]:
    """A commit for each nation (25 rows at any scale), on branch ``nations``; and their hashes by key."""

    def make() -> tuple[Repository, list[str]]:
        repo, made = new(spark), []
        for n in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect():
            k = n["n_nationkey"]
            above = made[max(0, k - 1) : k] + (made[k - 3 : k - 2] if k and k % 5 == 0 else [])
            made.append(repo.store.put_commit(Commit(str(n["n_regionkey"]), tuple(above), n["n_name"], 1_700_000_000.0 + k * 10, "me")))
        repo.store.update_ref("nations", None, made[-1])
        repo.create_branch("early", "nations~6")
        return repo, made

    return _once(spark, "history", sf_dir, make)


def imported(spark: SparkSession, sf_dir: str) -> Repository:
    """Nations and regions (of fixed size at any scale) by way of a SQLite file; nations once more without a key."""

    def make() -> Repository:
        path = f"{shared_dir(spark).removeprefix('file://')}/import-{uuid.uuid4().hex}.db"
        nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet").collect() for t in ("nation", "region"))
        with closing(sqlite3.connect(path)) as db:
            db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INTEGER)")
            db.execute("CREATE TABLE region (r_regionkey INTEGER PRIMARY KEY, r_name TEXT)")
            db.execute("CREATE TABLE visits (who TEXT)")
            db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [(n["n_nationkey"], n["n_name"], n["n_regionkey"]) for n in nation])
            db.executemany("INSERT INTO region VALUES (?, ?)", [(r["r_regionkey"], r["r_name"]) for r in region])
            db.executemany("INSERT INTO visits VALUES (?)", [(n["n_name"],) for n in sorted(nation, key=lambda n: n["n_nationkey"])])
            db.commit()
        repo = new(spark, SMALL)
        import_database(repo, path)
        Path(path).unlink()
        return repo

    return _once(spark, "imported", sf_dir, make)


def catalog(spark: SparkSession, sf_dir: str) -> Repository:
    """Four tables in a first commit; in a second, customers inserted over others, and suppliers deleted."""

    def make() -> Repository:
        repo = new(spark, SMALL)
        read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
        draft = repo.draft()
        for name, key in KEYS.items():
            draft.create_table(name, read(name).schema, [key])
            draft.insert_rows(name, read(name))
        draft.commit("load")
        draft = repo.draft()
        draft.insert_rows("customer", read("customer").where("c_custkey % 4 = 0").selectExpr("c_custkey + 2 as c_custkey", "'moved' as c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
        draft.delete_rows("supplier", read("supplier").where("s_suppkey % 3 = 0"))
        draft.commit("change")
        return repo

    return _once(spark, "catalog", sf_dir, make)


def talk(spark: SparkSession, sf_dir: str) -> Repository:
    """Turns of conversations under a compound key, in small chunks."""

    def make() -> Repository:
        repo = new(spark, SMALL)
        draft = repo.draft()
        draft.create_table("talk", TALK, ["conv_id", "turn"])
        draft.insert_rows("talk", spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role"))
        draft.commit("load")
        return repo

    return _once(spark, "talk", sf_dir, make)
