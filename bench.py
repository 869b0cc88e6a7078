"""Headline timings, as one JSON line: commits, differences, scans, garbage collection, and a few registered queries.

Every entry is the time of one run after a warm-up of the session; ``detail`` has rows a second and
what pruning left to read.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from palimpsest.operators import diff
from palimpsest.plans import registry
from palimpsest.session import session
from palimpsest.sources.repository import Repository

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = ("diff_events", "table_diff_rows", "column_change_pct", "upsert_batch", "upsert_last_wins", "scan_prefix", "entry_hash", "snapshot_fingerprint", "hash_commonality")


def main() -> None:
    spark = session(f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    top = tempfile.mkdtemp(prefix="bench-")
    times: dict[str, float] = {}
    detail: dict[str, object] = {}

    def timed(name, run):
        began = time.perf_counter()
        out = run()
        times[name] = round(time.perf_counter() - began, 3)
        return out

    def drain(frame):
        frame.write.format("noop").mode("overwrite").save()

    read = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet")
    drain(read("orders").groupBy("o_orderstatus").count())
    warm = Repository.init(spark, f"{top}/warm")
    draft = warm.draft()
    draft.create_table("region", read("region").schema, ["r_regionkey"])
    draft.replace_rows("region", read("region"))
    draft.commit("warm")

    repo = timed("init", lambda: Repository.init(spark, f"{top}/repo"))

    def commit(name, rows, key, message):
        draft = repo.draft()
        if name not in draft.tables:
            draft.create_table(name, rows.schema, key)
        draft.replace_rows(name, rows)
        return draft.commit(message)

    orders = read("orders")
    lines = read("lineitem").withColumn("rowid", F.monotonically_increasing_id())
    for name, rows, key in (("orders", orders, ["o_orderkey"]), ("lineitem", lines.select("rowid", *lines.columns[:-1]), ["rowid"])):
        timed(f"commit_{name}", lambda n=name, r=rows, k=key: commit(n, r, k, n))
        detail[f"commit_{name}_rows_per_s"] = round(rows.count() / times[f"commit_{name}"])

    def changed(share):
        hit = F.pmod(F.xxhash64("o_orderkey"), F.lit(int(1 / share))) == 0
        return orders.withColumn("o_totalprice", F.when(hit, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))

    for label, share in (("0.1pct", 0.001), ("10pct", 0.1)):
        timed(f"recommit_{label}", lambda s=share, m=label: commit("orders", changed(s), ["o_orderkey"], m))
        timed(f"diff_{label}", lambda: drain(repo.diff()))
        timed(f"row_diff_{label}", lambda: drain(repo.row_diff("orders")))
        detail[f"leaves_{label}"] = repo.diff_stats("HEAD~", "HEAD").first().asDict()
        commit("orders", orders, ["o_orderkey"], f"back from {label}")

    def upsert(share):
        draft = repo.draft()
        hit = F.pmod(F.xxhash64("o_orderkey"), F.lit(int(1 / share))) == 0
        draft.insert_rows("orders", orders.where(hit).withColumn("o_totalprice", F.col("o_totalprice") + 2))
        return draft.commit("upsert")

    timed("upsert_0.1pct", lambda: upsert(0.001))
    commit("orders", orders, ["o_orderkey"], "back from upsert")
    timed("prefix_scan", lambda: drain(repo.snapshot().read_rows("lineitem", "12")))
    timed("point_get", lambda: repo.snapshot().get("/d/orders/42"))
    timed("full_scan", lambda: drain(repo.table("lineitem")))
    timed("db_diff", lambda: repo.db_diff("HEAD~2", "HEAD~1").summary())
    timed("diff_summary", lambda: diff.summary(repo.diff("HEAD~2", "HEAD~1")).collect())
    timed("gc_dry_run", lambda: repo.gc(dry_run=True))
    for name in QUERIES:
        timed(name, lambda n=name: drain(registry.QUERIES[n](spark, SF_DIR)))
    detail["store_mb"] = round(sum(p.stat().st_size for p in Path(top, "repo").rglob("*") if p.is_file()) / 1e6, 1)
    spark.stop()
    shutil.rmtree(top, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf"), "detail": detail}))


if __name__ == "__main__":
    main()
