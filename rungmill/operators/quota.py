"""Quotas for each category: how many records are still needed, and taking that many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungmill.functions.levels import TAXONOMY, resolve_model, taxonomy
from rungmill.functions.names import free


def unknown_categories(records: DataFrame, category: str = "category") -> DataFrame:
    """(category): those in use that the taxonomy lacks, in their own spelling, null left out."""
    used = records.where(F.col(category).isNotNull()).select(F.col(category).alias("category")).distinct()
    return used.join(F.broadcast(taxonomy(records.sparkSession)), "category", "left_anti")


def check_categories(wanted: list[str]) -> None:
    """Raises for categories outside the taxonomy, named in order."""
    if unknown := sorted(set(wanted) - set(TAXONOMY)):
        raise ValueError(f"unknown categories: {', '.join(unknown)}")


def needed(existing: DataFrame, samples: int, wanted: list[str] | None = None, category: str = "category") -> DataFrame:
    """(category, existing, needed) of each wanted category (all by default) that has fewer than ``samples`` records."""
    spark = existing.sparkSession
    check_categories(wanted or [])
    asked = taxonomy(spark) if not wanted else taxonomy(spark).where(F.col("category").isin(wanted))
    counts = existing.groupBy(F.coalesce(F.col(category), F.lit("")).alias("_c")).agg(F.count("*").alias("n"))
    have = F.coalesce("n", F.lit(0))
    plan = asked.join(counts, F.col("category") == F.col("_c"), "left").select("category", have.alias("existing"), (F.lit(samples) - have).cast("long").alias("needed"))
    return plan.where("needed > 0")


def take(candidates: DataFrame, plan: DataFrame, samples: int, ordinal: str, category: str = "category") -> DataFrame:
    """The first ``needed`` candidates of each category in order of their ordinal; no category needs more than ``samples``.

    The constant bound lets every partition drop all but its first ``samples`` rows of a category before the shuffle.
    """
    w = W.partitionBy(F.col(category)).orderBy(F.col(ordinal))
    place, wanted, most = free(candidates, "place", "wanted", "most")
    first = candidates.where(F.col(category).isNotNull()).withColumn(place, F.row_number().over(w)).where(F.col(place) <= samples)
    plan = plan.select(F.col("category").alias(wanted), F.col("needed").alias(most))  # at most one row for each category of the taxonomy
    return first.join(F.broadcast(plan), F.col(category) == F.col(wanted)).where(F.col(place) <= F.col(most)).drop(place, wanted, most)


def plan_total(spark: SparkSession, samples: int, wanted: list[str] | None = None) -> DataFrame:
    """One row (categories, samples, total): what a run would ask for in all; reads nothing."""
    return dry_run(spark, samples, wanted).agg(F.count("*").alias("categories"), F.lit(samples).cast("long").alias("samples"), F.coalesce(F.sum("samples"), F.lit(0)).alias("total"))


def seed_records(prompts: DataFrame, model: Column, seed: int, category: str = "category", prompt: str = "prompt") -> DataFrame:
    """(category, prompt_safe, red_team_model, seed): the records of a run, the model under its full id, the run's seed on each."""
    return prompts.select(F.col(category).alias("category"), F.col(prompt).alias("prompt_safe"), resolve_model(model).alias("red_team_model"), F.lit(seed).cast("long").alias("seed"))


def dry_run(spark: SparkSession, samples: int, wanted: list[str] | None = None) -> DataFrame:
    """(category, samples): what a run would ask for; reads nothing."""
    check_categories(wanted or [])
    asked = taxonomy(spark) if not wanted else taxonomy(spark).where(F.col("category").isin(wanted))
    return asked.select("category", F.lit(samples).cast("long").alias("samples"))
