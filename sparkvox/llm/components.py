"""Connected components by alternating large and small stars, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvox.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang on the least of its neighbours and itself."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the least of them. In: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars apart: every a has one b, and no b is an a."""
    more = edges.groupBy("a").agg(F.count("*").alias("n"), F.lit(True).alias("child"))
    roots = edges.select(F.col("b").alias("a")).distinct().withColumns({"n": F.lit(0), "child": F.lit(False)})
    both = more.unionByName(roots).groupBy("a").agg(F.max("n").alias("n"), F.count("*").alias("kinds"))
    return both.where("n > 1 OR kinds > 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for each node with an edge: root is the least node that
    can be reached. Rounds, logarithmic in the number of nodes in practice, run
    until the edges are stars apart; each is written to the shared folder. Sums
    are made per task first, and the joins have one row per node on one side,
    so a node with a third of the edges does not gather in one task."""
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), "cc")
    while True:
        now = written(_small(written(_large(now), "cc")).distinct(), "cc")
        if _stars(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
