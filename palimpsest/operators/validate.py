"""Checks of order and of node structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(entries: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Keys that occur more than once, with how often."""
    out = entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys)
    return out if limit is None else out.limit(limit)


def out_of_order(entries: DataFrame, position: str = "ord", key: str = "key", group: list[str] | None = None) -> DataFrame:
    """Rows whose key is not above the one before, with that key; ``group`` (chunks of a sequence) bounds what is sorted in one task."""
    w = Window.partitionBy(*(group or [])).orderBy(position)
    seen = entries.withColumn("previous", F.lag(key).over(w))
    return seen.where(F.col(key) <= F.col("previous")).withColumn("problem", F.when(F.col(key) == F.col("previous"), "duplicate").otherwise("out of order"))


def node_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_hash, problem): missing children, separators that aren't their child's first key, children that overlap."""
    child = nodes.select(F.col("node_hash").alias("child_hash"), "first_key", "last_key")
    seen = edges.join(child, "child_hash", "left")
    w = Window.partitionBy("parent_hash").orderBy("ord")
    seen = seen.withColumn("next_first", F.lead("first_key").over(w))
    problem = (
        F.when(F.col("first_key").isNull(), "missing child")
        .when((F.col("ord") > 0) & ~F.col("separator").eqNullSafe(F.col("first_key")), "separator is not the child's first key")
        .when(F.col("next_first") <= F.col("last_key"), "children overlap")
    )
    return seen.select(F.col("parent_hash").alias("node_hash"), problem.alias("problem")).where("problem is not null")
