"""Ladders: clusters with an id and an anchor, their rungs, and the rungs they lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungmill.functions.identity import ladder_id
from rungmill.functions.levels import LEVELS, level_rank, norm_level
from rungmill.operators.components import components


def assign_ladders(records: DataFrame, edges: DataFrame, ordinal: str, category: str, score: str) -> DataFrame:
    """(ordinal, category, cluster, ladder_id, anchor): each record's cluster by its smallest ordinal, with an index in its category and its best record.

    Records without an edge are clusters of their own. Indexes count the clusters of a category from 0 in order of their smallest ordinal;
    the anchor is the record with the highest score, then the smallest ordinal. A null category has no ladder id. Counting is done on
    ranges of clusters whose sizes are added up, so no task sorts a whole category.
    """
    comp = components(edges).withColumnsRenamed({"node": "_node", "component": "_component"})
    r = records.select(F.col(ordinal).cast("long").alias("ordinal"), F.col(category).alias("category"), F.col(score).cast("double").alias("score"))
    r = r.join(comp, F.col("ordinal") == F.col("_node"), "left").withColumn("cluster", F.coalesce("_component", "ordinal")).drop("_node", "_component")
    best = F.max(F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-F.col("ordinal")).alias("o")))
    clusters = r.groupBy("category", "cluster").agg(best.alias("best"))
    block = F.shiftright("cluster", 16)
    sizes = clusters.groupBy("category", block.alias("block")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("category").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("category", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("category", "block").orderBy("cluster")) - 1
    numbered = clusters.withColumn("block", block).withColumn("inside", inside)
    numbered = numbered.join(sizes.withColumnsRenamed({"category": "_c", "block": "_b"}), F.col("category").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    named = numbered.select(F.col("category").alias("_c"), F.col("cluster").alias("_cluster"), F.when(F.col("category").isNotNull(), ladder_id(F.col("category").cast("string"), F.col("before") + F.col("inside"))).alias("ladder_id"), (-F.col("best.o")).alias("anchor"))
    out = r.join(named, (F.col("cluster") == F.col("_cluster")) & F.col("category").eqNullSafe(F.col("_c")))
    return out.select("ordinal", "category", "cluster", "ladder_id", "anchor")


def rungs_long(ladders: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each rung struct that is present, with level, rank, prompt, image_path, explanation and score; no shuffle."""
    rungs = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(k).cast("long").alias("rank"), F.col(f"rung_{x}").isNotNull().alias("present"), F.col(f"rung_{x}.prompt").alias("prompt"), F.col(f"rung_{x}.image_path").alias("image_path"), F.col(f"rung_{x}.explanation").alias("explanation"), F.col(f"mllm_score_{x}").alias("score")) for k, x in enumerate(LEVELS)])
    return ladders.select(*keys, F.inline(F.filter(rungs, lambda x: x["present"]))).drop("present")


def gaps(records: DataFrame, ladder: str = "ladder_id", level: str = "target_severity") -> DataFrame:
    """(ladder_id, level, rank): levels that a ladder lacks. Levels are read despite spelling; unknown ones count as none; null ladders are left out.

    Four bits for each ladder are combined before the shuffle, so a ladder with a third of all rows is no hot spot.
    """
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1), level_rank(norm_level(F.col(level))).cast("int")), F.lit(0))
    have = records.where(F.col(ladder).isNotNull()).groupBy(F.col(ladder).alias("ladder_id")).agg(F.bit_or(bit).alias("have"))
    every = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(k).cast("long").alias("rank"), F.lit(1 << k).alias("bit")) for k, x in enumerate(LEVELS)])
    missing = F.filter(every, lambda x: F.col("have").bitwiseAND(x["bit"]) == 0)
    return have.select("ladder_id", F.inline(missing)).drop("bit")


def pivot(records: DataFrame, value: str, ordinal: str, ladder: str = "ladder_id", level: str = "target_severity") -> DataFrame:
    """(ladder_id, one column for each level): the value of the level's record with the smallest ordinal; null where a ladder lacks the level."""
    lv = norm_level(F.col(level))
    one = [F.min_by(F.col(value), F.when(lv == x, F.col(ordinal))).alias(x) for x in LEVELS]
    seen = [F.min(F.when(lv == x, F.col(ordinal))).alias(f"_{x}") for x in LEVELS]
    wide = records.where(F.col(ladder).isNotNull()).groupBy(F.col(ladder).alias("ladder_id")).agg(*one, *seen)
    return wide.select("ladder_id", *[F.when(F.col(f"_{x}").isNotNull(), F.col(x)).alias(x) for x in LEVELS])
