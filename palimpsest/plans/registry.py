"""Registered queries over the driver's tables, and the DuckDB SQL that gives the same rows.

Two versions of a table are made from one: rows whose key ends in 3 are new, those that end in 7
are gone, and some values change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import hashes, keys
from palimpsest.operators import chunking, diff, graph, scans, stats, upsert, validate
from palimpsest.plans import repository
from palimpsest.sources.repository import Repository

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- two versions of customer ---------------------------------------------------------------------

_COLUMNS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
_OLD = f"old AS (SELECT {_COLUMNS} FROM customer WHERE c_custkey % 10 <> 3)"
_NEW = """new AS (SELECT c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 25 = 0 THEN 'X' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_custkey % 10 <> 7)"""
VERSIONS = f"WITH {_OLD}, {_NEW}"


def customer_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(*_COLUMNS.split(", "))
    new = rows.where(k % 10 != 7).withColumn("c_acctbal", F.when(k % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(k % 25 == 0, "X").otherwise(F.col("c_mktsegment")))
    return rows.where(k % 10 != 3), new


_KV_OLD = "kv_old AS (SELECT '/d/customer/' || c_custkey AS key, c_mktsegment AS value FROM old)"
_KV_NEW = "kv_new AS (SELECT '/d/customer/' || c_custkey AS key, c_mktsegment AS value FROM new)"
_EVENTS = """events AS (
  SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'deleted' ELSE 'modified' END AS change_type,
         o.value AS old_value, n.value AS new_value
  FROM kv_old o FULL OUTER JOIN kv_new n ON o.key = n.key
  WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value)"""
_KV = f"{VERSIONS}, {_KV_OLD}, {_KV_NEW}, {_EVENTS}"


def _kv(rows: DataFrame) -> DataFrame:
    return rows.select(keys.row_key("customer", ["c_custkey"]).alias("key"), F.col("c_mktsegment").alias("value"))


def _events(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    old, new = customer_versions(spark, sf_dir)
    return diff.kv_diff(_kv(old), _kv(new), prefix)


@query(f"{_KV} SELECT * FROM events")
def diff_events(spark, sf_dir):
    return _events(spark, sf_dir)


@query(f"{_KV} SELECT count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'modified') AS modified, count(*) AS total FROM events")
def diff_summary(spark, sf_dir):
    return diff.summary(_events(spark, sf_dir))


@query(f"{_KV} SELECT * FROM events WHERE starts_with(key, '/d/customer/1')")
def diff_prefix(spark, sf_dir):
    return _events(spark, sf_dir, "/d/customer/1")


@query(f"{_KV} SELECT * FROM events ORDER BY key LIMIT 25")
def diff_limit_ordered(spark, sf_dir):
    return scans.ordered(_events(spark, sf_dir), limit=25)


@query(f"{_KV} SELECT key, change_type, new_value AS old_value, old_value AS new_value FROM (SELECT key, CASE change_type WHEN 'added' THEN 'deleted' WHEN 'deleted' THEN 'added' ELSE change_type END AS change_type, old_value, new_value FROM events)")
def diff_reversed(spark, sf_dir):
    old, new = customer_versions(spark, sf_dir)
    return diff.kv_diff(_kv(new), _kv(old))


_ROWS = """rows AS (
  SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
         CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'deleted' ELSE 'modified' END AS status,
         CASE WHEN o.c_custkey IS NULL OR n.c_custkey IS NULL THEN '' ELSE concat_ws(',',
           CASE WHEN o.c_name IS DISTINCT FROM n.c_name THEN 'c_name' END, CASE WHEN o.c_nationkey IS DISTINCT FROM n.c_nationkey THEN 'c_nationkey' END,
           CASE WHEN o.c_acctbal IS DISTINCT FROM n.c_acctbal THEN 'c_acctbal' END, CASE WHEN o.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'c_mktsegment' END) END AS changed,
         o.c_acctbal AS old_acctbal, n.c_acctbal AS new_acctbal, o.c_mktsegment AS old_segment, n.c_mktsegment AS new_segment
  FROM old o FULL OUTER JOIN new n ON o.c_custkey = n.c_custkey),
changed AS (SELECT * FROM rows WHERE status <> 'modified' OR changed <> '')"""
_ROW_DIFF = f"{VERSIONS}, {_ROWS}"


def _rows(spark, sf_dir) -> DataFrame:
    old, new = customer_versions(spark, sf_dir)
    return diff.row_diff(old, new, ["c_custkey"])


@query(f"{_ROW_DIFF} SELECT c_custkey, status, changed, old_acctbal, new_acctbal, old_segment, new_segment FROM changed")
def table_diff_rows(spark, sf_dir):
    return _rows(spark, sf_dir).select("c_custkey", "status", F.array_join("changed_columns", ",").alias("changed"), F.col("old.c_acctbal").alias("old_acctbal"), F.col("new.c_acctbal").alias("new_acctbal"), F.col("old.c_mktsegment").alias("old_segment"), F.col("new.c_mktsegment").alias("new_segment"))


@query(f"{_ROW_DIFF} SELECT status, count(*) AS n FROM changed GROUP BY status")
def table_diff_counts(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


_COUNTS = f"{_ROW_DIFF}, counts AS (SELECT unnest(string_split(changed, ',')) AS \"column\", 1 AS one FROM changed WHERE status = 'modified')"


@query(f"{_COUNTS} SELECT DISTINCT \"column\" FROM counts")
def table_diff_changed_columns(spark, sf_dir):
    return _rows(spark, sf_dir).select(F.explode("changed_columns").alias("column")).distinct()


@query(f"{_COUNTS} SELECT \"column\", count(*) AS changes FROM counts GROUP BY 1")
def column_change_counts(spark, sf_dir):
    return diff.column_counts(_rows(spark, sf_dir)).select("column", "changes")


@query(f"{_COUNTS} SELECT \"column\", count(*) AS changes, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM changed WHERE status = 'modified') AS pct FROM counts GROUP BY 1 ORDER BY changes DESC, 1")
def column_change_pct(spark, sf_dir):
    return diff.column_counts(_rows(spark, sf_dir))


@query("SELECT 'c_region' AS \"column\", 'added' AS change UNION ALL SELECT 'c_acctbal', 'removed'")
def schema_diff(spark, sf_dir):
    old = read(spark, sf_dir, "customer")
    change = diff.schema_change(old, old.drop("c_acctbal").withColumn("c_region", F.lit(1)), ["c_custkey"], ["c_custkey"])
    return spark.createDataFrame([(c, "added") for c in change.added_columns] + [(c, "removed") for c in change.removed_columns], "column string, change string")


def _databases(spark, sf_dir):
    old, new = customer_versions(spark, sf_dir)
    nation, region, supplier = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    return (
        {"customer": (old, ["c_custkey"]), "nation": (nation, ["n_nationkey"]), "region": (region, ["r_regionkey"])},
        {"customer": (new, ["c_custkey"]), "nation": (nation.where("n_nationkey <> 4"), ["n_nationkey"]), "supplier": (supplier, ["s_suppkey"])},
    )


@query("SELECT * FROM (VALUES ('customer', 'changed'), ('nation', 'changed'), ('region', 'removed'), ('supplier', 'added')) AS t(name, status)")
def db_diff_tables(spark, sf_dir):
    d = diff.db_diff(*_databases(spark, sf_dir))
    return spark.createDataFrame([(t, "added") for t in d.added] + [(t, "removed") for t in d.removed] + [(t, "changed") for t in d.changed()], "name string, status string")


@query(f"{_ROW_DIFF} SELECT 'customer' AS name, status, count(*) AS n FROM changed GROUP BY status UNION ALL SELECT 'nation', 'deleted', count(*) FROM nation WHERE n_nationkey = 4")
def db_diff_totals(spark, sf_dir):
    d = diff.db_diff(*_databases(spark, sf_dir))
    parts = [t.rows.select(F.lit(name).alias("name"), "status") for name, t in d.common.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name", "status").agg(F.count("*").alias("n"))


# --- scans and the key space ----------------------------------------------------------------------


def _orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(keys.row_key("orders", ["o_orderkey"]).alias("key"), "o_orderkey", "o_custkey", "o_orderpriority")


_ORDERS = "WITH e AS (SELECT '/d/orders/' || o_orderkey AS key, o_orderkey, o_custkey, o_orderpriority FROM orders)"


@query(f"{_ORDERS} SELECT * FROM e WHERE starts_with(key, '/d/orders/12')")
def scan_prefix(spark, sf_dir):
    return scans.prefix(_orders(spark, sf_dir), "/d/orders/12")


@query(f"{_ORDERS} SELECT * FROM e WHERE key >= '/d/orders/95'")
def scan_seek(spark, sf_dir):
    return scans.seek(_orders(spark, sf_dir), "/d/orders/95")


@query(f"{_ORDERS} SELECT * FROM e WHERE key = '/d/orders/42'")
def point_get(spark, sf_dir):
    return scans.point(_orders(spark, sf_dir), "/d/orders/42")


@query(f"{_ORDERS} SELECT * FROM e ORDER BY key LIMIT 10")
def cursor_first(spark, sf_dir):
    return scans.ordered(_orders(spark, sf_dir), limit=10)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE starts_with(o_orderkey::VARCHAR, '7')")
def read_rows_prefix(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("pk", keys.pk_text(["o_orderkey"]))
    return scans.prefix(rows, "7", "pk").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation")
def count_rows(spark, sf_dir):
    one = lambda t: read(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("orders").unionByName(one("nation"))


@query("SELECT '/d/conversations/' || conv_id || '/' || turn AS key, role FROM conversations")
def pk_encode_compound(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(keys.row_key("conversations", ["conv_id", "turn"]).alias("key"), "role")


@query("SELECT 'conversations' AS name, conv_id || '/' || turn AS pk FROM conversations")
def pk_from_key(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(keys.row_key("conversations", ["conv_id", "turn"]).alias("key"))
    return rows.select(keys.table_of_row_key(F.col("key")).alias("name"), keys.pk_of_row_key(F.col("key")).alias("pk"))


@query("SELECT '[' || n_nationkey || ',' || to_json(n_name)::VARCHAR || ',' || n_regionkey || ',null]' AS value FROM nation")
def raw_rows(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(keys.row_json(["n_nationkey", "n_name", "n_regionkey", F.lit(None).cast("string")]).alias("value"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def reconstruct_rows(spark, sf_dir):
    raw = read(spark, sf_dir, "nation").select(keys.row_json(["n_nationkey", "n_name", "n_regionkey"]).alias("value"))
    row = F.from_json("value", "array<string>")
    return raw.select(F.get(row, 0).cast("int").alias("n_nationkey"), F.get(row, 1).alias("n_name"), F.get(row, 2).cast("int").alias("n_regionkey"))


_TABLES = " UNION ALL ".join(f"SELECT '{t}' AS name, '{k}' AS primary_key, count(*) AS n FROM {t}{' WHERE s_suppkey % 3 <> 0' if t == 'supplier' else ' FULL JOIN (SELECT c_custkey + 2 AS k FROM customer WHERE c_custkey % 4 = 0) ON c_custkey = k' if t == 'customer' else ''}" for t, k in repository.KEYS.items())


def _tables(spark, sf_dir, names: list[str] | None = None) -> DataFrame:
    snap = repository.catalog(spark, sf_dir).snapshot()
    rows = [(t, ",".join(snap.get_table(t).primary_key), snap.count_rows(t)) for t in names or snap.list_tables()]
    return spark.createDataFrame(rows, "name string, primary_key string, n long")


@query(f"{_TABLES} ORDER BY name")
def list_tables(spark, sf_dir):
    return _tables(spark, sf_dir)


@query(f"SELECT * FROM ({_TABLES}) WHERE name = 'supplier'")
def get_table(spark, sf_dir):
    return _tables(spark, sf_dir, ["supplier"])


# --- upserts --------------------------------------------------------------------------------------

_UPSERT = f"{VERSIONS}, batch AS (SELECT * FROM new WHERE c_custkey % 4 = 0)"


@query(f"{_UPSERT} SELECT * FROM batch UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM batch)")
def upsert_batch(spark, sf_dir):
    old, new = customer_versions(spark, sf_dir)
    return upsert.upsert(old, new.where("c_custkey % 4 = 0"), ["c_custkey"])


@query(f"{_UPSERT} SELECT count(*) AS rows, count(o.c_custkey) AS replaced, count(*) - count(o.c_custkey) AS inserted FROM batch b LEFT JOIN old o ON b.c_custkey = o.c_custkey")
def batch_stats(spark, sf_dir):
    old, new = customer_versions(spark, sf_dir)
    return upsert.batch_stats(old, new.where("c_custkey % 4 = 0"), ["c_custkey"])


@query(f"{VERSIONS} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
def delete_keys(spark, sf_dir):
    old, new = customer_versions(spark, sf_dir)
    return upsert.delete(old, new, ["c_custkey"])


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_LINE_ORDER = "l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


@query(f"SELECT {_LINE} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _LINE_ORDER.split(', '))}) AS rn FROM lineitem) WHERE rn = 1")
def upsert_last_wins(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(*_LINE.split(", "))
    return upsert.last_wins(rows, ["l_orderkey", "l_linenumber"], _LINE_ORDER.split(", "))


# --- hashes, chunks, sizes ------------------------------------------------------------------------


@query("""WITH e AS (SELECT o_orderkey, '/d/orders/' || o_orderkey AS key FROM orders)
SELECT o_orderkey, h FROM (SELECT o_orderkey, ('0x' || substr(sha256(unhex('0000002a') || encode(key)), 1, 8))::BIGINT AS h FROM e) WHERE h < 42949672""")
def leaf_split_candidates(spark, sf_dir):
    rows = _orders(spark, sf_dir).select("o_orderkey", hashes.boundary_hash(F.col("key"), 42).alias("h"))
    return rows.where(F.col("h") < int(0.01 * 2**32))


@query("SELECT '/d/orders/' || o_orderkey AS key, sha256(strlen('/d/orders/' || o_orderkey) || ':/d/orders/' || o_orderkey || strlen(o_orderpriority) || ':' || o_orderpriority) AS digest FROM orders")
def entry_hash(spark, sf_dir):
    return _orders(spark, sf_dir).select("key", hashes.entry_digest(F.col("key"), F.col("o_orderpriority")).alias("digest"))


_FINGERPRINT = "SELECT o_orderkey // 100 AS chunk, substr(sha256(string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY o_orderkey)), 1, 32) AS node_hash FROM orders GROUP BY 1"


def _fingerprints(orders: DataFrame) -> DataFrame:
    parts = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda e: F.concat(e.o_orderkey.cast("string"), F.lit(":"), e.o_orderpriority))
    return orders.groupBy(F.expr("o_orderkey div 100").alias("chunk")).agg(hashes.node_hash(parts).alias("node_hash"))


@query(_FINGERPRINT)
def snapshot_fingerprint(spark, sf_dir):
    return _fingerprints(read(spark, sf_dir, "orders"))


@query("SELECT count(*) AS n, sum(n_chars)::BIGINT AS total, avg(n_chars) AS average, min(n_chars) AS smallest, max(n_chars) AS largest FROM documents")
def size_stats(spark, sf_dir):
    return stats.size_stats(read(spark, sf_dir, "documents"), "n_chars")


_HISTOGRAM = """WITH e AS (SELECT min(n_chars) AS a, greatest(1, (max(n_chars) - min(n_chars) + 1) // 10) AS w FROM documents),
b AS (SELECT (n_chars - a) // w AS bucket, a, w, count(*) AS n FROM documents, e GROUP BY 1, 2, 3)"""


@query(f"{_HISTOGRAM} SELECT bucket, a + bucket * w AS lo, a + bucket * w + w - 1 AS hi, (a + bucket * w) || '-' || (a + bucket * w + w - 1) AS label, n, n * 100.0::DOUBLE / sum(n) OVER () AS pct FROM b")
def size_histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "documents"), "n_chars")


# --- sets, graphs ---------------------------------------------------------------------------------

_CHUNKS = """old_nodes AS (SELECT substr(sha256(string_agg(c_custkey || ':' || c_mktsegment, '|' ORDER BY c_custkey)), 1, 32) AS node FROM old GROUP BY c_custkey // 20),
new_nodes AS (SELECT substr(sha256(string_agg(c_custkey || ':' || c_mktsegment, '|' ORDER BY c_custkey)), 1, 32) AS node FROM new WHERE c_custkey // 20 % 3 = 0 GROUP BY c_custkey // 20
  UNION ALL SELECT node FROM old_nodes WHERE node < '8')"""


def _nodes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    old, new = customer_versions(spark, sf_dir)

    def chunk(rows: DataFrame) -> DataFrame:
        parts = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda e: F.concat(e.c_custkey.cast("string"), F.lit(":"), e.c_mktsegment))
        return rows.groupBy(F.expr("c_custkey div 20").alias("chunk")).agg(hashes.node_hash(parts).alias("node")).select("chunk", "node")

    a = chunk(old).select("node")
    return a, chunk(new).where("chunk % 3 = 0").select("node").unionByName(a.where("node < '8'"))


_SIDES = f"{VERSIONS}, {_CHUNKS}, sides AS (SELECT node, CASE WHEN bool_and(l) THEN 'left_only' WHEN NOT bool_or(l) THEN 'right_only' ELSE 'both' END AS side FROM (SELECT node, true AS l FROM old_nodes UNION ALL SELECT node, false FROM new_nodes) GROUP BY node)"


@query(f"{_SIDES} SELECT node, side FROM sides")
def hash_commonality(spark, sf_dir):
    return graph.commonality(*_nodes(spark, sf_dir))


@query(f"{_SIDES}, n AS (SELECT count(*) FILTER (side = 'left_only') AS left_only, count(*) FILTER (side = 'right_only') AS right_only, count(*) FILTER (side = 'both') AS \"both\", count(*) AS total FROM sides) SELECT *, \"both\" * 100.0::DOUBLE / total AS both_pct FROM n")
def commonality_totals(spark, sf_dir):
    return graph.commonality_totals(graph.commonality(*_nodes(spark, sf_dir)))


@query(f"{VERSIONS}, {_CHUNKS} SELECT DISTINCT node FROM new_nodes WHERE node NOT IN (SELECT node FROM old_nodes)")
def put_if_absent(spark, sf_dir):
    old, new = _nodes(spark, sf_dir)
    return new.distinct().join(old, "node", "left_anti")


# a node for each region, nation and customer; edges lead from a region to its nations and on to their customers
_EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
nodes AS (SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer)"""


def _edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(customer.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    nodes = region.select(name("r", "r_regionkey").alias("node")).unionByName(nation.select(name("n", "n_nationkey").alias("node"))).unionByName(customer.select(name("c", "c_custkey").alias("node")))
    return edges, nodes


def _roots(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"WITH RECURSIVE {_EDGES}, live AS (SELECT node FROM (VALUES ('r1'), ('n7')) AS t(node) UNION SELECT child FROM edges JOIN live ON parent = node) SELECT node FROM live")
def reachable_nodes(spark, sf_dir):
    edges, _ = _edges(spark, sf_dir)
    return graph.reachable(edges, _roots(spark, "r1", "n7"))


_LIVE = f"WITH RECURSIVE {_EDGES}, live AS (SELECT node FROM (VALUES ('r1'), ('r2'), ('n7')) AS t(node) UNION SELECT child FROM edges JOIN live ON parent = node)"


@query(f"{_LIVE} SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM live)")
def garbage_nodes(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return graph.garbage(nodes, graph.reachable(edges, _roots(spark, "r1", "r2", "n7", "gone"), missing=nodes))


@query(f"{_LIVE}, s AS (SELECT count(*) AS total, count(*) FILTER (node IN (SELECT node FROM live)) AS reachable FROM nodes) SELECT total, reachable, total - reachable AS garbage, reachable * 100.0::DOUBLE / total AS reachable_pct, (total - reachable) * 100.0::DOUBLE / total AS garbage_pct FROM s")
def gc_stats(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    return graph.gc_stats(nodes, graph.reachable(edges, _roots(spark, "r1", "r2", "n7"), missing=nodes))


@query(f"WITH RECURSIVE {_EDGES}, head AS (SELECT node FROM (VALUES ('r1'), ('r2')) AS t(node) UNION SELECT child FROM edges JOIN head ON parent = node), base AS (SELECT node FROM (VALUES ('r1')) AS t(node) UNION SELECT child FROM edges JOIN base ON parent = node) SELECT node FROM head WHERE node NOT IN (SELECT node FROM base)")
def push_set(spark, sf_dir):
    edges, _ = _edges(spark, sf_dir)
    return graph.push_set(edges, _roots(spark, "r1", "r2"), _roots(spark, "r1"))


# a commit for each nation, above the one before it and, for keys that 5 divides, above the third before it as well
_JSON = """sha256('{"author": "me", "message": ' || to_json(n_name) || ', "parents": [' || %s || '], "pattern": 0.01, "seed": 42, "timestamp": ' || (1700000000 + n_nationkey * 10) || '.0, "tree_root": "' || n_regionkey || '"}')"""
_COMMITS = f"""WITH RECURSIVE chain AS (
  SELECT n_nationkey AS k, n_name AS message, {_JSON % "''"} AS hash, NULL::VARCHAR AS one, NULL::VARCHAR AS two FROM nation WHERE n_nationkey = 0
  UNION ALL
  SELECT n_nationkey, n_name, {_JSON % """'"' || hash || '"' || CASE WHEN n_nationkey % 5 = 0 THEN ', "' || two || '"' ELSE '' END"""}, hash, one FROM chain JOIN nation ON n_nationkey = k + 1
), commits AS (SELECT k, message, hash, (1700000000 + k * 10)::DOUBLE AS ts FROM chain),
parents AS (SELECT k, k - 1 AS p FROM commits WHERE k > 0 UNION ALL SELECT k, k - 3 FROM commits WHERE k > 0 AND k % 5 = 0),
seen AS (SELECT 17 AS k UNION SELECT p FROM parents JOIN seen USING (k)),
walked AS (SELECT row_number() OVER (ORDER BY ts DESC, hash) - 1 AS ord, hash, message, ts FROM seen JOIN commits USING (k))"""


def _log(spark, sf_dir, limit: int | None = None) -> DataFrame:
    repo, names = repository.history(spark, sf_dir)
    return repo.log_frame(names[17], limit).select("ord", "hash", "message", F.col("timestamp").alias("ts"))


@query(f"{_COMMITS} SELECT * FROM walked")
def commit_walk(spark, sf_dir):
    return _log(spark, sf_dir)


@query(f"{_COMMITS} SELECT * FROM walked ORDER BY ord LIMIT 5")
def log_limit(spark, sf_dir):
    return _log(spark, sf_dir, 5)


@query(f"""{_COMMITS}, last AS (SELECT max(k) AS k FROM commits)
SELECT 'nations' AS ref, hash FROM commits SEMI JOIN last USING (k) UNION ALL SELECT 'nations~', hash FROM commits WHERE k = (SELECT k - 1 FROM last)
UNION ALL SELECT 'nations~4', hash FROM commits WHERE k = (SELECT k - 4 FROM last) UNION ALL SELECT 'nations~99', NULL UNION ALL SELECT 'nowhere', NULL
UNION ALL SELECT upper(c.hash[:12]), c.hash FROM commits c""")
def resolve_refs(spark, sf_dir):
    """Names, ancestors and beginnings of hashes, in capitals; two that lead nowhere."""
    repo, names = repository.history(spark, sf_dir)
    refs = ["nations", "nations~", "nations~4", "nations~99", "nowhere", *(h[:12].upper() for h in names)]
    return spark.createDataFrame([(r, repo.resolve(r)) for r in refs], "ref string, hash string")


@query(f"{_COMMITS} SELECT 'nations' AS name, hash FROM commits WHERE k = (SELECT max(k) FROM commits) UNION ALL SELECT 'early', hash FROM commits WHERE k = (SELECT max(k) - 6 FROM commits)")
def list_branches(spark, sf_dir):
    repo, _ = repository.history(spark, sf_dir)
    return spark.createDataFrame([(n, h) for n, h in repo.list_branches().items() if n != "main"], "name string, hash string")


@query("""SELECT o_orderkey, o_custkey, previous, CASE WHEN o_custkey = previous THEN 'duplicate' ELSE 'out of order' END AS problem
FROM (SELECT o_orderkey, o_custkey, lag(o_custkey) OVER (PARTITION BY o_orderkey // 256 ORDER BY o_orderkey) AS previous FROM orders) WHERE o_custkey <= previous""")
def validate_sorted(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("o_orderkey div 256").alias("chunk"))
    return validate.out_of_order(rows, "o_orderkey", "o_custkey", ["chunk"]).drop("chunk")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5")
def validate_duplicates(spark, sf_dir):
    return validate.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 5)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, lag('/d/orders/' || o_orderkey) OVER (PARTITION BY o_orderkey // 512 ORDER BY o_orderkey) AS p FROM orders) WHERE '/d/orders/' || o_orderkey <= p")
def validate_out_of_order(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("chunk", F.expr("o_orderkey div 512"))
    return validate.out_of_order(rows, "o_orderkey", "key", ["chunk"]).select("o_orderkey")


# --- the repository itself: commits, reads at a version, pruned differences -----------------------


@query(f"{VERSIONS} SELECT * FROM old")
def time_travel_read(spark, sf_dir):
    return repository.two_commits(spark, *customer_versions(spark, sf_dir), sf_dir).table("customer", "HEAD~1")


@query(f"{VERSIONS} SELECT * FROM new")
def head_read(spark, sf_dir):
    return repository.two_commits(spark, *customer_versions(spark, sf_dir), sf_dir).table("customer", "HEAD")


@query(f"{_ROW_DIFF} SELECT c_custkey, status, changed FROM changed")
def pruned_row_diff(spark, sf_dir):
    repo = repository.two_commits(spark, *customer_versions(spark, sf_dir), sf_dir)
    return repo.row_diff("customer", "HEAD~1", "HEAD").select("c_custkey", "status", F.array_join("changed_columns", ",").alias("changed"))


@query("SELECT 'customer' AS \"table\", count(*) AS n_entries FROM customer WHERE c_custkey % 10 <> 7")
def manifest_counts(spark, sf_dir):
    repo = repository.two_commits(spark, *customer_versions(spark, sf_dir), sf_dir)
    return repo.manifest("HEAD").groupBy("table").agg(F.sum("n_entries").alias("n_entries"))


_HEAD = """batch AS (SELECT c_custkey + 2 AS c_custkey, 'moved' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 = 0),
head AS (SELECT * FROM batch UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM batch))"""


def _head(spark, sf_dir):
    return repository.catalog(spark, sf_dir).snapshot()


@query(f"WITH {_HEAD} SELECT * FROM head")
def repo_insert_rows(spark, sf_dir):
    return _head(spark, sf_dir).table("customer")


@query("SELECT * FROM supplier WHERE s_suppkey % 3 <> 0")
def repo_delete_rows(spark, sf_dir):
    return _head(spark, sf_dir).table("supplier")


@query("SELECT '/d/nation/7' AS key, '[' || n_nationkey || ',' || to_json(n_name)::VARCHAR || ',' || n_regionkey || ']' AS value FROM nation WHERE n_nationkey = 7")
def repo_get(spark, sf_dir):
    return spark.createDataFrame([("/d/nation/7", _head(spark, sf_dir).get("/d/nation/7"))], "key string, value string")


@query(f"WITH {_HEAD} SELECT * FROM head WHERE c_custkey::VARCHAR >= '95'")
def repo_seek(spark, sf_dir):
    return _head(spark, sf_dir).seek("customer", "95")


@query(f"WITH {_HEAD} SELECT * FROM head WHERE starts_with(c_custkey::VARCHAR, '12')")
def repo_prefix(spark, sf_dir):
    return _head(spark, sf_dir).read_rows("customer", "12")


@query("SELECT '/d/nation/' || n_nationkey AS key, '[' || n_nationkey || ',' || to_json(n_name)::VARCHAR || ',' || n_regionkey || ']' AS value FROM nation WHERE starts_with(n_nationkey::VARCHAR, '1')")
def repo_dump(spark, sf_dir):
    return _head(spark, sf_dir).entries("/d/nation/1")


@query(f"""WITH {_HEAD}, counts AS (
  SELECT 'customer' AS name, count(*) FILTER (c.c_custkey IS NULL) AS added, 0 AS deleted,
         count(*) FILTER (c.c_custkey IS NOT NULL AND (c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment) IS DISTINCT FROM (h.c_name, h.c_nationkey, h.c_acctbal, h.c_mktsegment)) AS modified
  FROM head h LEFT JOIN customer c USING (c_custkey)
  UNION ALL SELECT 'supplier', 0, count(*) FILTER (s_suppkey % 3 = 0), 0 FROM supplier UNION ALL SELECT 'nation', 0, 0, 0 UNION ALL SELECT 'region', 0, 0, 0)
SELECT * FROM counts""")
def repo_db_diff(spark, sf_dir):
    found = repository.catalog(spark, sf_dir).db_diff().counts()
    return spark.createDataFrame([(t, n["added"], n["deleted"], n["modified"]) for t, n in found.items()], "name string, added long, deleted long, modified long")


@query(f"WITH {_HEAD} SELECT * FROM head")
def repo_push(spark, sf_dir):
    """What a clone reads after a push."""
    here = repository.catalog(spark, sf_dir)
    there = Repository(spark, f"{here.path}-clone-{uuid.uuid4().hex}")
    here.push(there)
    return there.table("customer", "main")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def repo_gc(spark, sf_dir):
    """What is left of a clone whose branch went back a commit, after a collection."""
    here = repository.catalog(spark, sf_dir)
    there = Repository(spark, f"{here.path}-gc-{uuid.uuid4().hex}")
    here.push(there)
    there.store.set_ref("main", there.resolve("main~1"))
    there.gc()
    return there.table("customer", "main")


@query("SELECT 'nation' AS name, n_nationkey AS k, n_name AS label FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region UNION ALL SELECT 'visits', row_number() OVER (ORDER BY n_nationkey), n_name FROM nation")
def sqlite_import(spark, sf_dir):
    """Two tables with keys and one without, from a SQLite file, as a commit holds them."""
    snap = repository.imported(spark, sf_dir).snapshot()
    parts = [snap.table(t).select(F.lit(t).alias("name"), F.col(k).cast("long").alias("k"), F.col(v).alias("label")) for t, k, v in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name"), ("visits", "rowid", "who"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT '/d/nation/' || n_nationkey AS key, '[' || n_nationkey || ',' || to_json(n_name)::VARCHAR || ',' || n_regionkey || ']' AS value FROM nation")
def sqlite_import_dump(spark, sf_dir):
    return repository.imported(spark, sf_dir).snapshot().entries("/d/nation/")


_S = repository.SMALL
_CUT = f"({{held}} >= {_S.most} OR ({{held}} >= {_S.least} AND mark < floor(least({int(_S.pattern * 2**32)} * pow(2, {{held}}::DOUBLE / {_S.target}), {2**31}))))"


_LEAVES = f"""WITH RECURSIVE e AS (
  SELECT row_number() OVER (ORDER BY key) AS i, key, strlen(key) + strlen(value) AS size, ('0x' || substr(sha256(unhex('{_S.seed:08x}') || encode(key)), 1, 8))::BIGINT AS mark,
         sha256(strlen(key) || ':' || key || strlen(value) || ':' || value) AS digest
  FROM (SELECT '/d/talk/' || conv_id || '/' || turn AS key, '[' || conv_id || ',' || turn || ',' || to_json(role)::VARCHAR || ']' AS value FROM conversations)
), walk AS (
  SELECT i, size AS held, 0 AS leaf, {_CUT.format(held="size")} AS cut FROM e WHERE i = 1
  UNION ALL
  SELECT e.i, CASE WHEN w.cut THEN e.size ELSE w.held + e.size END, w.leaf + CASE WHEN w.cut THEN 1 ELSE 0 END, {_CUT.format(held="(CASE WHEN w.cut THEN e.size ELSE w.held + e.size END)")}
  FROM walk w JOIN e ON e.i = w.i + 1
)"""


@query(f"""{_LEAVES}
SELECT leaf::BIGINT AS ord, min(key) AS first_key, max(key) AS last_key, count(*) AS n_entries, sum(size)::BIGINT AS n_bytes,
       substr(sha256('{chunking.node_hash(["talk", repository.TALK.json()])}|' || string_agg(digest, '' ORDER BY key)), 1, 32) AS leaf_hash
FROM walk JOIN e USING (i) GROUP BY leaf""")
def repo_leaves(spark, sf_dir):
    """The chunker's leaves, cut in parallel, against one scan."""
    return repository.talk(spark, sf_dir).snapshot().leaves("talk").drop("table")


@query(f"""{_LEAVES}
SELECT 'talk' AS tree, 0 AS problems UNION ALL SELECT 'catalog', 0 UNION ALL SELECT 'talk without every third leaf', count(DISTINCT leaf) FROM walk WHERE leaf % 3 = 0""")
def repo_structure(spark, sf_dir):
    """Faults in trees (separators, order, missing children): none in sound ones, and a missing child for each leaf that is taken out."""
    snap = repository.talk(spark, sf_dir).snapshot()
    gone = snap.leaves("talk").where("ord % 3 = 0").select(F.col("leaf_hash").alias("node_hash"))
    damaged = validate.node_problems(snap.nodes().where("is_leaf").join(gone, "node_hash", "left_anti"), snap.edges().where("level = 1")).where("problem = 'missing child'")
    found = {"talk": snap.problems(), "catalog": repository.catalog(spark, sf_dir).snapshot().problems(), "talk without every third leaf": damaged}
    parts = [frame.agg(F.count("*").alias("problems")).select(F.lit(name).alias("tree"), "problems") for name, frame in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT sum(n)::BIGINT AS entries, count(*) AS tables FROM (SELECT count(*) AS n FROM conversations)")
def repo_stats(spark, sf_dir):
    """Entries below the leaves' level of node statistics."""
    snap = repository.talk(spark, sf_dir).snapshot()
    return snap.stats().where("is_leaf").agg(F.sum("entries").alias("entries")).select("entries", F.lit(len(snap.list_tables())).cast("long").alias("tables"))
