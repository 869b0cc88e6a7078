"""Connected components of links between keys, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import common


def _large(edges: DataFrame) -> DataFrame:
    """Each key's larger neighbours hang on the least of its neighbours and itself; links may repeat."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    """Each key and its smaller neighbours hang on the least of these; ``edges`` lead from the larger key."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a <> b").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every key hangs on one root that hangs on nothing."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.lit(1).alias("down")), F.struct(F.col("b").alias("key"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    per_key = ends.groupBy("key").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    return per_key.where("down > 1 or (down = 1 and least = 0)").isEmpty()


def components(links: DataFrame, most_turns: int = 200) -> DataFrame:
    """(key, root): every key that links (a, b) name but the roots, each with the least key of its component. The links may repeat and go either way."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(most_turns):
        edges = common.stage(_small(_large(edges)), "edges")
        if _is_star(edges):
            return edges.select(F.col("a").alias("key"), F.col("b").alias("root"))
    raise RuntimeError(f"links are not resolved after {most_turns} turns")
