"""Closures and set operations over node and commit graphs."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.staging import cut

MOST_DEPTH = 10_000


def reachable(edges: DataFrame, roots: DataFrame, *, missing: DataFrame | None = None) -> DataFrame:
    """Distinct ``node`` values reachable from ``roots`` (column node) along (parent, child) edges, roots included.

    Breadth first, one join a level: a tree of n entries has about log n levels. With ``missing``
    (known nodes) a node outside of it is neither returned nor followed.
    """
    frontier = roots.select("node").distinct()
    if missing is not None:
        frontier = frontier.join(missing.select("node"), "node", "left_semi")
    frontier = cut(frontier)
    seen = frontier
    for _ in range(MOST_DEPTH):
        step = edges.join(frontier.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        if missing is not None:
            step = step.join(missing.select("node"), "node", "left_semi")
        frontier = cut(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier))
    raise RuntimeError("the graph is deeper than expected")


def garbage(nodes: DataFrame, live: DataFrame) -> DataFrame:
    return nodes.select("node").distinct().join(live, "node", "left_anti")


def gc_stats(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """One row: total, reachable, garbage, and the latter two in percent (0 without nodes)."""
    marked = nodes.select("node").distinct().join(live.select("node", F.lit(1).alias("live")), "node", "left")
    out = marked.agg(F.count("*").alias("total"), F.count("live").alias("reachable"))
    pct = lambda c: F.when(F.col("total") > 0, c * 100.0 / F.col("total")).otherwise(0.0)
    return out.select("total", "reachable", (F.col("total") - F.col("reachable")).alias("garbage"), pct(F.col("reachable")).alias("reachable_pct"), pct(F.col("total") - F.col("reachable")).alias("garbage_pct"))


def commonality(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node, side): left_only, right_only or both; each side's nodes count once."""
    a, b = left.select("node", F.lit(1).alias("l")).distinct(), right.select("node", F.lit(1).alias("r")).distinct()
    return a.join(b, "node", "full_outer").select("node", F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both").alias("side"))


def commonality_totals(sides: DataFrame) -> DataFrame:
    """One row: left_only, right_only, both, total, and the share of both in percent."""
    count = lambda s: F.count(F.when(F.col("side") == s, 1)).alias(s)
    out = sides.agg(count("left_only"), count("right_only"), count("both"), F.count("*").alias("total"))
    return out.select("*", F.when(F.col("total") > 0, F.col("both") * 100.0 / F.col("total")).otherwise(0.0).alias("both_pct"))


def push_set(edges: DataFrame, head: DataFrame, base: DataFrame) -> DataFrame:
    """Nodes reachable from ``head`` but not from ``base``."""
    return reachable(edges, head).join(reachable(edges, base), "node", "left_anti")


def walk(starts: Iterable[str], parents: Callable[[str], tuple[float, list[str]] | None]) -> Iterator[str]:
    """Commits newest first, each once, parents after a child even if their time is later; unknown ones are passed over. Ties go by hash.

    ``parents``: time and parents of a commit. Commits are metadata, a few hundred bytes each.
    """
    heap: list[tuple[float, str, list[str]]] = []
    seen: set[str] = set()

    def add(name: str) -> None:
        if name not in seen:
            seen.add(name)
            if found := parents(name):
                heapq.heappush(heap, (-found[0], name, found[1]))

    for name in starts:
        add(name)
    while heap:
        _, name, above = heapq.heappop(heap)
        yield name
        for p in above:
            add(p)
