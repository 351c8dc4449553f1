"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungmill.plans.staging import Staging


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = e.unionAll(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of the component of each node that has an edge.

    Null ends and self pairs are left out; order and repetition of edges have no effect; no edge gives an empty table. Rounds are written
    tables; they go on until a round changes nothing, which the number of edges and the sums of two hashes of them tell.
    """
    stage = Staging(edges.sparkSession, "components")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = stage.table(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "round-0")
    k, before = 0, None
    while True:
        now = tuple(e.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")) for seed in (0, 1))).first())
        if now == before:
            break
        k, before = k + 1, now
        e = stage.table(_small_star(_large_star(e)), f"round-{k}")
        stage.drop(f"round-{k - 1}")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
