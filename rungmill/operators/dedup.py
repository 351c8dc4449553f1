"""Exact deduplication that keeps the most descriptive record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungmill.functions.names import free


def exact_dedup(records: DataFrame, keys: list[str], score: Column, ordinal: str) -> DataFrame:
    """One record for each key: that of the highest score, then of the smallest ordinal.

    A record with a null in any key column always stays. A null score is lower than any other, NaN counts as null. The best record of each
    key is sought in every partition before the shuffle, so a key with a third of all rows sends one row from each.
    """
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    value = score.cast("double")
    best = W.partitionBy(*keys).orderBy(F.when(~F.isnan(value), value).desc_nulls_last(), F.col(ordinal).asc_nulls_last())
    (place,) = free(records, "place")
    kept = records.where(has_key).withColumn(place, F.row_number().over(best)).where(F.col(place) == 1).drop(place)
    return kept.unionByName(records.where(~has_key))


def removed(records: DataFrame, kept: DataFrame) -> DataFrame:
    """One row (rows_in, rows_out, removed)."""
    n = records.agg(F.count("*").alias("rows_in")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("rows_out"))))  # one row each
    return n.withColumn("removed", F.col("rows_in") - F.col("rows_out"))
