"""A repository of versioned tables.

::

    HEAD, refs/<name>/<n>, commits/<hash>.json      metadata, by CommitStore
    snapshots/<root>.json                            tables: columns, types, key, root of the table's tree
    manifests/<root>/                                Parquet: table, leaf_hash, ord, first_key, last_key, n_entries, n_bytes
    trees/<root>/                                    Parquet: edges of the tables' trees
    data/_write=<id>/, index/<id>/                   rows of new leaves, sorted by key; which leaves they are

A leaf's rows are written once, whichever snapshots share them. Everything is written before the
commit, and the commit before its ref, so a job that dies leaves at most garbage. Reading a table at
a version is one scan of the writes that hold its leaves; reads by key or prefix take the leaves that
can hold them, by the manifest's bounds; a difference reads only the leaves not shared.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import hashes, keys
from palimpsest.operators import chunking, diff, graph, incremental, scans, stats, upsert, validate
from palimpsest.sources.commits import Commit, CommitStore, RefConflict
from palimpsest.sources.files import Files
from palimpsest.sources.staging import cut, scratch

#: The table of plain key-value entries; its keys are the whole key.
KV = "_kv"
KV_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
MANIFEST = "table string, leaf_hash string, ord long, first_key string, last_key string, n_entries long, n_bytes long"
INDEX = "leaf_hash string, write string, write_ord long, n_entries long"
#: Names and numbers of leaves are under 100 bytes; a selection of more leaves is joined by shuffle.
BROADCAST_LEAVES = 200_000
#: A selection of so few leaves goes to the scan as ranges of keys too, so that Parquet's statistics skip what lies between.
PRUNED_LEAVES, PRUNED_RANGES = 20_000, 32
LEAVES_PER_FILE = 250_000
INTERNAL = ("_key", "_ord", "_write")
#: Key types with one text for each value, whatever the session's settings: batches on them touch the leaves with these texts only.
PLAIN_KEYS = (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.BooleanType)


@dataclass(frozen=True)
class TableInfo:
    """A table of a snapshot: Spark schema, declared types (as imported) and key columns."""

    schema: T.StructType
    primary_key: tuple[str, ...]
    declared: tuple[str, ...] = ()
    root: str = ""

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def to_json(self) -> dict:
        return {"schema": json.loads(self.schema.json()), "primary_key": list(self.primary_key), "declared": list(self.declared), "root": self.root}

    @staticmethod
    def from_json(found: dict) -> TableInfo:
        return TableInfo(T.StructType.fromJson(found["schema"]), tuple(found["primary_key"]), tuple(found["declared"]), found["root"])

    def described(self) -> str:
        """The schema entry's value."""
        types = self.declared or tuple(f.dataType.simpleString() for f in self.schema)
        return json.dumps({"columns": self.columns, "types": list(types), "primary_key": list(self.primary_key)}, separators=(",", ":"))


def full_key(table: str, info: TableInfo) -> Column:
    return F.col("key") if table == KV else keys.row_key(table, info.primary_key)


def _ranges(leaves: DataFrame) -> Column:
    """Whether a key is in the ranges of these leaves, the closest of them taken together; which rows are theirs is for a join to tell."""
    found = leaves.select("ord", "first_key", "last_key").orderBy("ord").collect()
    gaps = sorted(range(1, len(found)), key=lambda i: found[i - 1]["ord"] - found[i]["ord"])
    starts = [0, *sorted(i for i in gaps[: PRUNED_RANGES - 1] if found[i]["ord"] > found[i - 1]["ord"] + 1), len(found)]
    each = [F.col("_key").between(F.lit(found[a]["first_key"]), F.lit(found[b - 1]["last_key"])) for a, b in zip(starts, starts[1:], strict=False)]
    return functools.reduce(Column.__or__, each)


def value_text(table: str, info: TableInfo) -> Column:
    return F.col("value") if table == KV else keys.row_json(info.columns)


class Snapshot:
    """The tables at one root; lazy."""

    def __init__(self, repo: Repository, root: str):
        self.repo, self.root = repo, root
        text = repo.files.read(f"snapshots/{root}.json")
        if text is None:
            raise ValueError(f"no such snapshot: {root}")
        self.tables = {k: TableInfo.from_json(v) for k, v in json.loads(text).items()}

    def list_tables(self) -> list[str]:
        return sorted(t for t in self.tables if t != KV)

    def get_table(self, name: str) -> TableInfo | None:
        return self.tables.get(name)

    def _info(self, name: str) -> TableInfo:
        if name not in self.tables:
            raise ValueError(f"table {name!r} does not exist")
        return self.tables[name]

    def leaves(self, name: str | None = None) -> DataFrame:
        rows = self.repo.spark.read.schema(MANIFEST).parquet(self.repo.files.path(f"manifests/{self.root}"))
        return rows if name is None else rows.where(F.col("table") == name)

    def keyed(self, name: str, leaves: DataFrame | None = None) -> DataFrame:
        """A table's rows with _key; of these leaves only, if given."""
        info = self._info(name)
        return self.repo._rows(self.leaves(name) if leaves is None else leaves, info)

    def table(self, name: str) -> DataFrame:
        return self.keyed(name).drop(*INTERNAL)

    def _within(self, name: str, start: str) -> DataFrame:
        """Rows with _key that starts so, from the leaves that can hold such keys."""
        if not start:
            return self.keyed(name)
        leaves = self.leaves(name).where((F.col("last_key") >= start) & ((F.col("first_key") <= start) | F.col("first_key").startswith(start)))
        return scans.prefix(self.keyed(name, leaves), start, "_key")

    def read_rows(self, name: str, prefix: str = "", raw: bool = False) -> DataFrame:
        """Rows whose key text starts with ``prefix``; ``raw``: as JSON arrays in column order."""
        info = self._info(name)
        rows = self._within(name, prefix if name == KV else f"{keys.ROW_PREFIX}{name}/{prefix}") if prefix else self.keyed(name)
        return rows.select(value_text(name, info).alias("value")) if raw else rows.drop(*INTERNAL)

    def seek(self, name: str, target: str) -> DataFrame:
        """Rows from the first key text that is not below ``target`` on, in no order."""
        self._info(name)
        start = target if name == KV else f"{keys.ROW_PREFIX}{name}/{target}"
        return scans.seek(self.keyed(name, self.leaves(name).where(F.col("last_key") >= start)), start, "_key").drop(*INTERNAL)

    def count_rows(self, name: str) -> int:
        """From the manifest; no row is read."""
        self._info(name)
        return self.leaves(name).agg(F.coalesce(F.sum("n_entries"), F.lit(0))).first()[0]

    def count(self) -> int:
        """All entries, those of schemas included."""
        return self.leaves().agg(F.coalesce(F.sum("n_entries"), F.lit(0))).first()[0] + len(self.list_tables())

    def entries(self, prefix: str = "") -> DataFrame:
        """(key, value) of everything: schemas, rows, plain entries. Only tables that the prefix can reach are read."""
        schemas = [(f"{keys.SCHEMA_PREFIX}{t}", self.tables[t].described()) for t in self.list_tables()]
        out = self.repo.spark.createDataFrame([s for s in schemas if s[0].startswith(prefix)], "key string, value string")
        for name, info in self.tables.items():
            start = "" if name == KV else f"{keys.ROW_PREFIX}{name}/"
            if start.startswith(prefix) or prefix.startswith(start):
                rows = self._within(name, prefix if prefix.startswith(start) else "")
                out = out.unionByName(rows.select(F.col("_key").alias("key"), value_text(name, info).alias("value")))
        return out

    def get(self, key: str) -> str | None:
        """The entry's value; of the one table that can have the key, one leaf is read."""
        if key.startswith(keys.SCHEMA_PREFIX) and key[len(keys.SCHEMA_PREFIX) :] in self.list_tables():
            return self.tables[key[len(keys.SCHEMA_PREFIX) :]].described()
        for name in (n for n in (key.removeprefix(keys.ROW_PREFIX).split("/")[0] if key.startswith(keys.ROW_PREFIX) else None, KV) if n in self.tables):
            leaf = self.leaves(name).where((F.col("first_key") <= key) & (F.col("last_key") >= key))
            if found := scans.point(self.keyed(name, leaf), key, "_key").select(value_text(name, self.tables[name])).head():
                return found[0]
        return None

    def node(self, name: str) -> dict | None:
        """A node by its hash: its bounds and sizes if it is a leaf, its children if it is not, else None."""
        if leaf := self.leaves().where(F.col("leaf_hash") == name).head():
            return {"is_leaf": True} | leaf.asDict()
        children = self.edges().where(F.col("parent_hash") == name).orderBy("ord").select("ord", "child_hash", "separator", "level").collect()
        return {"is_leaf": False, "level": children[0]["level"], "children": [(r["child_hash"], r["separator"]) for r in children]} if children else None

    def edges(self) -> DataFrame:
        return self.repo.spark.read.schema(EDGES_SCHEMA).parquet(self.repo.files.path(f"trees/{self.root}"))

    def node_hashes(self) -> DataFrame:
        """(node) of the snapshot's trees: leaves, internal nodes, and the snapshot's root."""
        edges = self.edges()
        own = self.repo.spark.createDataFrame([(self.root,)], "node string")
        return self.leaves().select(F.col("leaf_hash").alias("node")).unionByName(edges.select(F.col("parent_hash").alias("node"))).unionByName(own).distinct()

    def nodes(self) -> DataFrame:
        """(node_hash, is_leaf, first_key, last_key, n_entries, n_bytes); an internal node counts its children."""
        leaf = self.leaves().select(F.col("leaf_hash").alias("node_hash"), F.lit(True).alias("is_leaf"), "first_key", "last_key", "n_entries", "n_bytes")
        inner = self.edges().groupBy(F.col("parent_hash").alias("node_hash")).agg(F.count("*").alias("n_entries"), F.sum(F.octet_length(F.coalesce("separator", F.lit(""))) + chunking.CHILD_HASH_BYTES).alias("n_bytes"))
        return leaf.unionByName(inner.select("node_hash", F.lit(False).alias("is_leaf"), F.lit(None).cast("string").alias("first_key"), F.lit(None).cast("string").alias("last_key"), "n_entries", "n_bytes"))

    def stats(self) -> DataFrame:
        return stats.node_stats(self.nodes())

    def problems(self) -> DataFrame:
        """Structure that is wrong: none in a sound snapshot."""
        return validate.node_problems(self.nodes().where("is_leaf"), self.edges().where("level = 1"))

    def view(self, prefix: str = "") -> None:
        """Make the tables temporary views, for Spark SQL."""
        for name in self.list_tables():
            self.table(name).createOrReplaceTempView(prefix + name)


EDGES_SCHEMA = chunking.EDGES


@dataclass
class Draft:
    """The next snapshot: the tables of a base, with changes. Nothing is written until ``write``."""

    repo: Repository
    base: Snapshot | None
    tables: dict[str, TableInfo] = field(default_factory=dict)
    changed: dict[str, DataFrame] = field(default_factory=dict)
    #: Instead of ``changed``, where all changes to a table of the base are by key: rows of one key each, _gone for deleted ones.
    patches: dict[str, DataFrame] = field(default_factory=dict)
    dropped: set[str] = field(default_factory=set)

    def _based(self, name: str) -> bool:
        return self.base is not None and name in self.base.tables and name not in self.dropped

    def _patchable(self, name: str) -> bool:
        info = self.tables[name]
        plain = all(isinstance(info.schema[c].dataType, PLAIN_KEYS) for c in info.primary_key) and "_gone" not in info.columns
        return name in self.patches or (plain and name not in self.changed and self._based(name) and self.base.tables[name] == info)

    def _patch(self, name: str, rows: DataFrame) -> None:
        self.patches[name] = upsert.upsert(self.patches[name], rows, self.tables[name].primary_key) if name in self.patches else rows

    def _set(self, name: str, rows: DataFrame) -> None:
        self.changed[name] = rows
        self.patches.pop(name, None)

    def _rows(self, name: str) -> DataFrame:
        if name in self.changed:
            return self.changed[name]
        if name not in self.tables:
            raise ValueError(f"table {name!r} does not exist")
        if name in self.patches:
            patch = self.patches[name]
            return upsert.upsert(self.base.table(name), patch, self.tables[name].primary_key, patch.where(~F.col("_gone")).drop("_gone"))
        if self._based(name):
            return self.base.table(name)
        return self.repo.spark.createDataFrame([], self.tables[name].schema)

    def create_table(self, name: str, schema: T.StructType | str, primary_key: Sequence[str], declared: Sequence[str] = ()) -> None:
        """Creating a table again replaces its schema; rows stay if the columns do, else they are cast or filled with null."""
        keys.check_table_name(name)
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        if missing := [c for c in primary_key if c not in kind.names]:
            raise ValueError(f"key columns not in the table: {missing}")
        old = self._rows(name) if name in self.tables else None
        self.tables[name] = TableInfo(kind, tuple(primary_key), tuple(declared))
        if old is not None:
            self._set(name, old.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in old.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind]))

    def insert_rows(self, name: str, rows: DataFrame, order: Sequence[str] | None = None) -> None:
        """Upsert by key. ``order`` tells which of rows with one key is last; without it their keys must be unique."""
        info = self.tables.get(name)
        if info is None:
            raise ValueError(f"table {name!r} does not exist")
        if order:
            rows = upsert.last_wins(rows, info.primary_key, order)
        fitted = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in info.schema])
        if self._patchable(name):
            self._patch(name, fitted.withColumn("_gone", F.lit(False)))
        else:
            known = name in self.changed or self._based(name)
            self._set(name, upsert.upsert(self._rows(name), fitted, info.primary_key) if known else fitted)

    def replace_rows(self, name: str, rows: DataFrame) -> None:
        info = self.tables[name]
        self._set(name, rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in info.schema]))

    def delete_rows(self, name: str, gone: DataFrame) -> None:
        if name not in self.tables:
            raise ValueError(f"table {name!r} does not exist")
        info = self.tables[name]
        if self._patchable(name) and all(gone.schema[c].dataType == info.schema[c].dataType for c in info.primary_key):
            whole = gone.select(*info.primary_key).dropna().distinct()
            self._patch(name, whole.select(*[F.col(f"`{f.name}`") if f.name in info.primary_key else F.lit(None).cast(f.dataType).alias(f.name) for f in info.schema], F.lit(True).alias("_gone")))
        else:
            self._set(name, upsert.delete(self._rows(name), gone, info.primary_key))

    def drop_table(self, name: str) -> None:
        self.tables.pop(name)
        self.changed.pop(name, None)
        self.patches.pop(name, None)
        self.dropped.add(name)

    def set(self, entries: DataFrame | Mapping[str, str]) -> None:
        """Upsert plain entries (key, value)."""
        if not isinstance(entries, DataFrame):
            entries = self.repo.spark.createDataFrame(list(entries.items()), KV_SCHEMA)
        if KV not in self.tables:
            self.tables[KV] = TableInfo(KV_SCHEMA, ("key",))
        self.insert_rows(KV, entries)

    def write(self) -> str:
        """Write what is new; the root."""
        return self.repo._write(self)

    def commit(self, message: str, author: str = "") -> str:
        return self.repo.commit(self.write(), message, author)


class Repository:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        self.store = CommitStore(self.files)

    # --- set-up and refs

    @staticmethod
    def init(spark: SparkSession, path: str, author: str = "", spec: chunking.Spec | None = None) -> Repository:
        """A new repository with an empty first commit on ``main``."""
        repo = Repository(spark, path)
        if repo.files.exists("commits"):
            raise FileExistsError(f"there is a repository at {path}")
        spec = spec or chunking.Spec()
        repo.files.write("config.json", json.dumps({"least": spec.least, "target": spec.target, "most": spec.most}))
        root = Draft(repo, None).write()
        commit = Commit(root, (), "Initial commit", time.time(), author, spec.pattern, spec.seed)
        repo.store.put_commit(commit)
        repo.store.update_ref("main", None, commit.hash)
        repo.store.set_head("main")
        return repo

    @staticmethod
    def open(spark: SparkSession, path: str) -> Repository:
        repo = Repository(spark, path)
        if not repo.files.exists("commits"):
            raise FileNotFoundError(f"no repository at {path}")
        return repo

    def get_head(self) -> tuple[str | None, str]:
        """(commit hash, ref name); a HEAD that is not set becomes ``main``."""
        name = self.store.get_head()
        if name is None:
            name = "main"
            self.store.set_head(name)
        return self.store.get_ref(name), name

    def spec(self) -> chunking.Spec:
        head = self.store.get_commit(self.get_head()[0] or "")
        sizes = json.loads(self.files.read("config.json") or "{}")
        return chunking.Spec(**sizes, **({"pattern": head.pattern, "seed": head.seed} if head else {}))

    def resolve(self, ref: str) -> str | None:
        """HEAD, HEAD~, HEAD~N and <ref>~N (first parents), a ref, a full hash, or the beginning of just one; else None."""
        if "~" in ref:
            name, _, steps = ref.partition("~")
            if not (steps == "" or steps.isdigit()):
                return None
            at = self.resolve(name)
            for _ in range(int(steps or 1)):
                above = self.store.get_parents(at) if at else ()
                at = above[0] if above else None
            return at
        if ref == "HEAD":
            return self.get_head()[0]
        if not ref:
            return None
        try:
            if at := self.store.get_ref(ref):
                return at
        except ValueError:
            pass
        return ref.lower() if self.store.get_commit(ref.lower()) else self.store.find_by_prefix(ref)

    def _commit_of(self, ref: str) -> Commit:
        found = self.resolve(ref)
        commit = self.store.get_commit(found) if found else None
        if commit is None:
            raise ValueError(f"no such commit: {ref!r}")
        return commit

    def create_branch(self, name: str, start: str | None = None) -> str:
        if self.store.get_ref(name):
            raise ValueError(f"branch {name!r} exists")
        at = self.resolve(start) if start else self.get_head()[0]
        if at is None:
            raise ValueError(f"no such commit: {start!r}" if start else "there are no commits")
        self.store.update_ref(name, None, at)
        return at

    def checkout(self, name: str) -> None:
        if not self.store.get_ref(name):
            raise ValueError(f"no such branch: {name!r}")
        self.store.set_head(name)

    def list_branches(self) -> dict[str, str]:
        return self.store.list_refs()

    def commit(self, root: str, message: str, author: str = "", *, pattern: float | None = None, seed: int | None = None) -> str:
        """A commit of a written root on the current branch. If the branch moved meanwhile: RefConflict."""
        at, name = self.get_head()
        head = self.store.get_commit(at) if at else None
        commit = Commit(root, (at,) if at else (), message, time.time(), author, pattern if pattern is not None else head.pattern if head else 0.01, seed if seed is not None else head.seed if head else 42)
        self.store.put_commit(commit)
        self.store.update_ref(name, at, commit.hash)
        return commit.hash

    def log(self, start: str | None = None, max_count: int | None = None) -> Iterator[tuple[str, Commit]]:
        """Commits newest first; none for an unknown ref."""
        at = self.resolve(start or "HEAD")
        for i, found in enumerate(self.store.walk(at) if at else ()):
            if max_count is not None and i >= max_count:
                return
            yield found

    def log_frame(self, start: str | None = None, max_count: int | None = None) -> DataFrame:
        rows = [(i, h, c.tree_root, list(c.parents), c.message, c.timestamp, c.author) for i, (h, c) in enumerate(self.log(start, max_count))]
        return self.spark.createDataFrame(rows, "ord long, hash string, tree_root string, parents array<string>, message string, timestamp double, author string")

    # --- snapshots

    def snapshot(self, ref: str = "HEAD") -> Snapshot:
        return Snapshot(self, self._commit_of(ref).tree_root)

    def snapshot_at(self, root: str) -> Snapshot:
        """The snapshot of a tree root, whether a commit has it or not."""
        return Snapshot(self, root)

    def _side(self, at: str | Snapshot) -> Snapshot:
        return at if isinstance(at, Snapshot) else self.snapshot(at)

    def table(self, name: str, ref: str = "HEAD") -> DataFrame:
        return self.snapshot(ref).table(name)

    def manifest(self, ref: str = "HEAD") -> DataFrame:
        return self.snapshot(ref).leaves()

    def draft(self, ref: str = "HEAD", *, empty: bool = False) -> Draft:
        """Changes on top of a version; ``empty``: a snapshot from scratch."""
        base = None if empty else self.snapshot(ref)
        return Draft(self, base, dict(base.tables) if base else {})

    def _index(self) -> DataFrame:
        names = self.files.list("index")
        if not names:
            return self.spark.createDataFrame([], INDEX)
        return self.spark.read.schema(INDEX).parquet(*[self.files.path(f"index/{n}") for n in names])

    def _rows(self, leaves: DataFrame, info: TableInfo) -> DataFrame:
        """Rows (with _key) of the leaves of one table: one scan, whatever the number of writes."""
        kind = T.StructType([*info.schema.fields, T.StructField("_key", T.StringType()), T.StructField("_ord", T.LongType()), T.StructField("_write", T.StringType())])
        index = self._index()
        placed = leaves.select("leaf_hash").distinct().join(index, "leaf_hash").groupBy("leaf_hash").agg(F.min(F.struct("write", "write_ord")).alias("at")).select(F.col("at.write").alias("_write"), F.col("at.write_ord").alias("_ord"))
        asked = placed.groupBy(F.col("_write").alias("write")).agg(F.count("*").alias("n")).join(index.groupBy("write").agg(F.count("*").alias("all")), "write").collect()
        if not asked:
            return self.spark.createDataFrame([], kind)
        rows = self._data([r["write"] for r in asked], kind)
        if any(r["n"] < r["all"] for r in asked):
            asked_leaves = sum(r["n"] for r in asked)
            if asked_leaves <= PRUNED_LEAVES:
                rows = rows.where(_ranges(leaves))
            few = asked_leaves <= BROADCAST_LEAVES
            rows = rows.join(F.broadcast(placed) if few else placed, ["_write", "_ord"], "left_semi").select(kind.names)
        return rows

    def _data(self, writes: Sequence[str], kind: T.StructType) -> DataFrame:
        return self.spark.read.schema(kind).option("basePath", self.files.path("data")).parquet(*[self.files.path(f"data/_write={w}") for w in sorted(writes)])

    def _write(self, draft: Draft) -> str:
        with scratch(self.spark):
            return self._write_all(draft)

    def _write_all(self, draft: Draft) -> str:
        spec, spark = self.spec() if self.files.exists("refs") else chunking.Spec(**json.loads(self.files.read("config.json") or "{}")), self.spark
        manifest = spark.createDataFrame([], MANIFEST)
        edges = spark.createDataFrame([], chunking.EDGES)
        known = draft.base.tables if draft.base else {}
        tables: dict[str, TableInfo] = {}
        for name, info in draft.tables.items():
            if name not in draft.changed and name not in draft.patches and name in known and known[name] == info:
                tables[name] = info
                manifest = manifest.unionByName(draft.base.leaves(name))
                continue
            leaves, new_edges, root = self._write_table(name, info, draft, spec)
            tables[name] = TableInfo(info.schema, info.primary_key, info.declared, root)
            manifest = manifest.unionByName(leaves.select(F.lit(name).alias("table"), "leaf_hash", "ord", "first_key", "last_key", "n_entries", "n_bytes"))
            edges = edges.unionByName(new_edges)
        if draft.base:
            kept = spark.createDataFrame([(t.root,) for n, t in tables.items() if n in known and known[n].root == t.root], "root string")
            old = draft.base.edges()
            edges = edges.unionByName(old.join(graph.reachable(old.select(F.col("parent_hash").alias("parent"), F.col("child_hash").alias("child")), kept.select(F.col("root").alias("node"))).withColumnRenamed("node", "parent_hash"), "parent_hash", "left_semi").select(edges.columns)) if not old.isEmpty() and not kept.isEmpty() else edges
        root = chunking.node_hash(["snapshot", *[part for n in sorted(tables) for part in (n, tables[n].described(), tables[n].schema.json(), tables[n].root)]])
        if not self.files.exists(f"snapshots/{root}.json"):
            manifest.coalesce(1 + manifest.count() // LEAVES_PER_FILE).write.mode("overwrite").parquet(self.files.path(f"manifests/{root}"))
            edges.distinct().coalesce(1 if not draft.base else 4).write.mode("overwrite").parquet(self.files.path(f"trees/{root}"))
            self.files.create(f"snapshots/{root}.json", json.dumps({n: t.to_json() for n, t in tables.items()}))
        return root

    def _write_table(self, name: str, info: TableInfo, draft: Draft, spec: chunking.Spec) -> tuple[DataFrame, DataFrame, str]:
        """Chunk a table, or what a batch touches of it, and write the leaves that aren't there yet; (leaves, edges, root)."""
        value = value_text(name, info)

        def measure(found: DataFrame) -> DataFrame:
            size = F.octet_length("_key") + F.coalesce(F.octet_length("_value"), F.lit(0))
            # a null key is told of later; until then it has a size and a digest like others
            return found.select("*", value.alias("_value")).select(
                *found.columns, F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.coalesce(hashes.boundary_hash(F.col("_key"), spec.seed), F.lit(0)).alias("_mark"),
                F.coalesce(hashes.entry_digest(F.col("_key"), F.col("_value")), F.lit("0" * chunking.DIGEST)).alias("_digest"),
            )

        salt, columns = chunking.node_hash([name, info.schema.json()]), [*info.columns, "_key"]
        if name in draft.patches:
            patch = cut(draft.patches[name].select("*", full_key(name, info).alias("_key")))
            if not patch.where("_key is null").isEmpty():
                raise ValueError(f"table {name!r}: key None is null or not unique")

            def changed(at: DataFrame) -> DataFrame:
                """The rows of these leaves, and those of the batch."""
                return draft.base.keyed(name, at).select(columns).join(patch.select("_key"), "_key", "left_anti").select(columns).unionByName(patch.where(~F.col("_gone")).select(columns))

            leaves, made = incremental.apply(draft.base.leaves(name).drop("table"), patch.select("_key"), changed, spec, salt, measure, chunking.estimate(patch))
        else:
            made = chunking.chunk(draft._rows(name).select(*info.columns, full_key(name, info).alias("_key")), spec, salt, measure)
            leaves = made.leaves
        if made.wrong:
            raise ValueError(f"table {name!r}: key {made.wrong[0]!r} is null or not unique")
        fresh = cut(made.leaves.join(self._index().select("leaf_hash").distinct(), "leaf_hash", "left_anti").select("leaf_hash", F.col("ord").alias("_ord"), "n_entries"))
        n = fresh.count()
        if n:
            kept = fresh.select("_ord")
            self._store(made.rows.join(F.broadcast(kept) if n <= BROADCAST_LEAVES else kept, "_ord", "left_semi").select(made.rows.columns) if n < made.leaves.count() else made.rows, fresh, n)
        root, edges = chunking.tree(self.spark, leaves, spec, chunking.node_hash(["empty", name]))
        return leaves, edges, root

    def _store(self, rows: DataFrame, fresh: DataFrame, n: int) -> str:
        """Write rows (columns, _key, _ord) of n leaves given by (leaf_hash, _ord, n_entries)."""
        write = uuid.uuid4().hex
        rows.sortWithinPartitions("_key").write.parquet(self.files.path(f"data/_write={write}"))
        fresh.select("leaf_hash", F.lit(write).alias("write"), F.col("_ord").alias("write_ord"), "n_entries").coalesce(4).write.parquet(self.files.path(f"index/{write}"))
        return write

    # --- differences

    def _pruned(self, a: Snapshot, b: Snapshot, name: str) -> tuple[DataFrame, DataFrame]:
        """A table's rows in the leaves that only a, and only b has. A key in a shared leaf is in no other, so nothing is lost."""
        x, y = a.leaves(name), b.leaves(name)
        return a.keyed(name, x.join(y.select("leaf_hash"), "leaf_hash", "left_anti")), b.keyed(name, y.join(x.select("leaf_hash"), "leaf_hash", "left_anti"))

    def diff_stats(self, old: str, new: str) -> DataFrame:
        """One row: leaves shared, and leaves to be compared on either side."""
        a, b = (self.snapshot(r).leaves().select("table", "leaf_hash").distinct() for r in (old, new))
        both = a.withColumn("o", F.lit(1)).join(b.withColumn("n", F.lit(1)), ["table", "leaf_hash"], "full_outer")
        return both.agg(F.count(F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), 1)).alias("leaves_skipped"), F.count(F.when(F.col("n").isNull(), 1)).alias("old_leaves"), F.count(F.when(F.col("o").isNull(), 1)).alias("new_leaves"))

    def diff(self, old: str | Snapshot = "HEAD~", new: str | Snapshot = "HEAD", prefix: str = "") -> DataFrame:
        """Key-value events between two versions (refs, or snapshots of any root): rows, schemas and plain entries."""
        return self.diff_snapshots(self._side(old), self._side(new), prefix)

    def diff_snapshots(self, a: Snapshot, b: Snapshot, prefix: str = "") -> DataFrame:
        empty = self.spark.createDataFrame([], "key string, value string")
        if a.root == b.root:
            return diff.kv_diff(empty, empty)
        sides = [self.spark.createDataFrame([(f"{keys.SCHEMA_PREFIX}{t}", s.tables[t].described()) for t in s.list_tables()], "key string, value string") for s in (a, b)]
        for name in sorted(set(a.tables) | set(b.tables)):
            start = "" if name == KV else f"{keys.ROW_PREFIX}{name}/"
            if not (start.startswith(prefix) or prefix.startswith(start)):
                continue
            if name in a.tables and name in b.tables:
                if a.tables[name].root == b.tables[name].root and a.tables[name].schema == b.tables[name].schema:
                    continue
                rows: list[DataFrame | None] = list(self._pruned(a, b, name))
            else:
                rows = [s.keyed(name) if name in s.tables else None for s in (a, b)]
            for i, (s, r) in enumerate(zip((a, b), rows, strict=True)):
                if r is not None:
                    sides[i] = sides[i].unionByName(r.select(F.col("_key").alias("key"), value_text(name, s.tables[name]).alias("value")))
        return diff.kv_diff(*sides, prefix)

    def row_diff(self, name: str, old: str | Snapshot = "HEAD~", new: str | Snapshot = "HEAD") -> DataFrame:
        return self.table_diff(name, self._side(old), self._side(new)).rows

    def table_diff(self, name: str, a: Snapshot, b: Snapshot) -> diff.TableDiff:
        x, y = a._info(name), b._info(name)
        if x.columns == y.columns:
            old, new = (r.drop(*INTERNAL) for r in self._pruned(a, b, name))
        else:
            old, new = a.table(name), b.table(name)
        return diff.table_diff(name, old, new, x.primary_key, y.primary_key)

    def db_diff(self, old: str | Snapshot = "HEAD~", new: str | Snapshot = "HEAD", tables: Sequence[str] | None = None) -> diff.DatabaseDiff:
        a, b = self._side(old), self._side(new)
        wanted = set(tables) if tables else set(a.list_tables()) | set(b.list_tables())
        x, y = set(a.list_tables()) & wanted, set(b.list_tables()) & wanted
        return diff.DatabaseDiff(sorted(y - x), sorted(x - y), {t: self.table_diff(t, a, b) for t in sorted(x & y)})

    def commonality(self, left: str = "HEAD~", right: str = "HEAD") -> DataFrame:
        return graph.commonality(self.snapshot(left).node_hashes(), self.snapshot(right).node_hashes())

    # --- garbage

    def live_commits(self) -> set[str]:
        return {h for h, _ in self.store.walk(*self.list_branches().values())}

    def live_roots(self) -> set[str]:
        return {c.tree_root for _, c in self.store.walk(*self.list_branches().values())}

    def _live_leaves(self, roots: set[str]) -> DataFrame:
        paths = [self.files.path(f"manifests/{r}") for r in sorted(roots)]
        found = self.spark.read.schema(MANIFEST).parquet(*paths) if paths else self.spark.createDataFrame([], MANIFEST)
        return found.select(F.col("leaf_hash").alias("node")).distinct()

    def gc_stats(self, roots: set[str] | None = None) -> DataFrame:
        """Leaves: total, reachable, garbage, percents. No roots make everything garbage; roots that aren't here count as none."""
        roots = self.live_roots() if roots is None else {r for r in roots if self.files.exists(f"snapshots/{r}.json")}
        return graph.gc_stats(self._index().select(F.col("leaf_hash").alias("node")), self._live_leaves(roots))

    def gc(self, dry_run: bool = False, roots: set[str] | None = None) -> dict[str, int]:
        """Remove leaves that no branch reaches, and the snapshots that held them; the counts. Run it while nobody writes."""
        kept = self.live_roots() if roots is None else {r for r in roots if self.files.exists(f"snapshots/{r}.json")}
        counts = self.gc_stats(kept).first().asDict()
        out = {k: counts[k] for k in ("total", "reachable", "garbage")}
        if dry_run:
            return out
        with scratch(self.spark):
            self._sweep(kept)
        for name in self.files.list("snapshots"):
            if (root := name.removesuffix(".json")) not in kept:
                for part in (f"snapshots/{name}", f"manifests/{root}", f"trees/{root}"):
                    self.files.delete(part)
        if roots is None:
            commits = self.live_commits()
            for h in self.store.commits():
                if h not in commits:
                    self.store.delete_commit(h)
        if (left := self._index().select("leaf_hash").distinct().count()) != out["reachable"]:
            raise RuntimeError(f"{left} leaves are left, not {out['reachable']}")
        return out

    def _sweep(self, kept: set[str]) -> None:
        """Delete writes without a live leaf, and move the leaves that stay out of the others."""
        live = cut(self._live_leaves(kept).withColumnRenamed("node", "leaf_hash"))
        index = cut(self._index())
        alive = {r["write"]: r["n"] for r in index.join(live, "leaf_hash", "left_semi").groupBy("write").agg(F.count("*").alias("n")).collect()}
        for r in index.groupBy("write").agg(F.count("*").alias("n")).collect():
            write, n = r["write"], alive.get(r["write"], 0)
            if n == r["n"]:
                continue
            if n:  # move the leaves that stay into a write of their own
                mine = index.where(F.col("write") == write).join(live, "leaf_hash", "left_semi").select("leaf_hash", F.col("write_ord").alias("_ord"), "n_entries")
                rows = self.spark.read.parquet(self.files.path(f"data/_write={write}"))
                self._store(rows.join(mine.select("_ord"), "_ord", "left_semi"), mine, n)
            for part in (f"index/{write}", f"data/_write={write}"):
                self.files.delete(part)

    # --- exchange

    def _copy_to(self, other: Repository, commits: list[tuple[str, Commit]]) -> int:
        """Copy commits (newest first) with what their snapshots need and ``other`` lacks; leaves copied."""
        with scratch(self.spark):
            return self._copy_all(other, commits)

    def _copy_all(self, other: Repository, commits: list[tuple[str, Commit]]) -> int:
        copied = 0
        for root in dict.fromkeys(c.tree_root for _, c in reversed(commits)):
            if other.files.exists(f"snapshots/{root}.json"):
                continue
            snap = Snapshot(self, root)
            for name, info in snap.tables.items():
                missing = cut(snap.leaves(name).select("leaf_hash", F.col("ord").alias("_to"), "n_entries").dropDuplicates(["leaf_hash"]).join(other._index().select("leaf_hash"), "leaf_hash", "left_anti"))
                n = missing.count()
                if not n:
                    continue
                # the rows of each leaf, numbered as in this snapshot
                spans = snap.leaves(name).join(missing, "leaf_hash", "left_semi").select("first_key", "last_key", F.col("ord").alias("_ord"), "leaf_hash", "n_entries")
                located = missing.select("leaf_hash", "_to").join(self._index(), "leaf_hash").groupBy("leaf_hash", "_to").agg(F.min(F.struct("write", "write_ord")).alias("at")).select("_to", "at.write", "at.write_ord")
                located = cut(located)
                kind = T.StructType([*info.schema.fields, T.StructField("_key", T.StringType()), T.StructField("write_ord", T.LongType()), T.StructField("_write", T.StringType())])
                stored = T.StructType([*kind.fields[:-2], T.StructField("_ord", T.LongType()), kind.fields[-1]])
                held = self._data([r["write"] for r in located.select("write").distinct().collect()], stored).toDF(*kind.names)
                parts = held.join(located.select(F.col("write").alias("_write"), "write_ord", F.col("_to").alias("_ord")), ["_write", "write_ord"]).select(*info.columns, "_key", "_ord")
                other._store(parts, spans.select("leaf_hash", "_ord", "n_entries").dropDuplicates(["leaf_hash"]), n)
                copied += n
            snap.leaves().write.mode("overwrite").parquet(other.files.path(f"manifests/{root}"))
            snap.edges().write.mode("overwrite").parquet(other.files.path(f"trees/{root}"))
            other.files.create(f"snapshots/{root}.json", self.files.read(f"snapshots/{root}.json"))
            if other._live_leaves({root}).withColumnRenamed("node", "leaf_hash").join(other._index(), "leaf_hash", "left_anti").limit(1).count():
                raise RuntimeError(f"snapshot {root} is not whole after copying")
        for _, commit in reversed(commits):
            other.store.put_commit(commit)
        return copied

    def nodes_to_push(self, base: str | None = None) -> DataFrame:
        """(node) of leaves in HEAD's history that the history of ``base`` lacks."""
        head = self.get_head()[0]
        mine = self._live_leaves({c.tree_root for _, c in self.store.walk(*([head] if head else []))})
        if base is None:
            return mine
        if (at := self.resolve(base)) is None:
            raise ValueError(f"no such commit: {base!r}")
        return mine.join(self._live_leaves({c.tree_root for _, c in self.store.walk(at)}), "node", "left_anti")

    def push(self, other: Repository, force: bool = False) -> dict[str, int]:
        """Send the current branch. Unless forced, the other side's commit must be an ancestor."""
        at, name = self.get_head()
        if at is None:
            raise ValueError("there are no commits")
        there = other.store.get_ref(name)
        history = list(self.store.walk(at))
        if there and not force and there not in {h for h, _ in history}:
            raise RefConflict(name, at, there)
        missing = [(h, c) for h, c in history if other.store.get_commit(h) is None]
        copied = self._copy_to(other, missing)
        if there != at:
            other.store.update_ref(name, there, at)
        return {"commits": len(missing), "leaves": copied}

    def pull(self, other: Repository, name: str | None = None, force: bool = False) -> dict[str, int]:
        """Fetch a branch (the current one). Unless forced, the local commit must be an ancestor."""
        name = name or self.get_head()[1]
        there, here = other.store.get_ref(name), self.store.get_ref(name)
        if there is None:
            raise ValueError(f"no such branch there: {name!r}")
        history = list(other.store.walk(there))
        if here and not force and here not in {h for h, _ in history}:
            raise RefConflict(name, here, there)
        missing = [(h, c) for h, c in history if self.store.get_commit(h) is None]
        copied = other._copy_to(self, missing)
        if here != there:
            self.store.update_ref(name, here, there)
        return {"commits": len(missing), "leaves": copied}
