"""Size statistics and exact histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def size_stats(sizes: DataFrame, size: str = "size") -> DataFrame:
    """One row: count, sum, average (0 where there is nothing), min, max."""
    return sizes.agg(F.count(size).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.coalesce(F.avg(size), F.lit(0.0)).alias("average"), F.min(size).alias("smallest"), F.max(size).alias("largest"))


def histogram(sizes: DataFrame, size: str = "size", buckets: int = 10) -> DataFrame:
    """(bucket, lo, hi, label, n, pct). The width is (largest - smallest + 1) div buckets, one at least, so there may be more buckets than asked for."""
    ends = sizes.agg(F.min(size).alias("a"), F.max(size).alias("b")).select(F.struct("a", F.greatest(F.lit(1), F.floor((F.col("b") - F.col("a") + 1) / buckets)).alias("w")).alias("e"))
    placed = sizes.where(F.col(size).isNotNull()).select(F.col(size).alias("s"), ends.scalar().alias("e"))
    counted = placed.groupBy(F.floor((F.col("s") - F.col("e.a")) / F.col("e.w")).alias("bucket"), F.col("e.a").alias("a"), F.col("e.w").alias("w")).agg(F.count("*").alias("n"))
    lo = F.col("a") + F.col("bucket") * F.col("w")
    hi = lo + F.col("w") - 1
    return counted.select("bucket", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.concat_ws("-", lo.cast("string"), hi.cast("string")).alias("label"), "n", (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))


def node_stats(nodes: DataFrame) -> DataFrame:
    """Count and average bytes of leaves and internal nodes."""
    return nodes.groupBy("is_leaf").agg(F.count("*").alias("n"), F.avg("n_bytes").alias("average_bytes"), F.sum("n_entries").alias("entries"))
