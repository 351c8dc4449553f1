"""Image files below one or more roots: which exist, and copying those that are referred to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.identity import safe_relative
from rungmill.functions.names import free


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path): the files below a root, relative to it; contents are not read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    return files.select(F.regexp_extract("path", r"^(?:\w+:/*)?/?" + re.escape(base.lstrip("/")) + r"/(.*)$", 1).alias("path")).where("path != ''")


def resolve(references: DataFrame, listings: list[DataFrame]) -> DataFrame:
    """Adds root: the number of the first listing that holds image_path, null where none does; null and empty paths are left out.

    Absolute paths and paths with '..' are in no root. Repeated references are kept one by one.
    """
    clean, path = free(references, "clean", "path")
    out = references.drop("root").where(F.coalesce("image_path", F.lit("")) != "").withColumn(clean, safe_relative(F.col("image_path")))
    held = [x.select(F.col("path").alias(path)).distinct().select(path, F.lit(k).alias("root")) for k, x in enumerate(listings)]
    every = held[0]
    for more in held[1:]:
        every = every.unionByName(more)
    first = every.groupBy(path).agg(F.min("root").alias("root"))
    return out.join(first, F.col(clean) == F.col(path), "left").drop(clean, path)


def found_and_missing(references: DataFrame, listings: list[DataFrame]) -> DataFrame:
    """One row (found, missing): references counted one by one."""
    x = resolve(references, listings)
    return x.agg(F.count_if(F.col("root").isNotNull()).alias("found"), F.count_if(F.col("root").isNull()).alias("missing"))


def copy_missing(resolved: DataFrame, roots: list[str], target: str) -> DataFrame:
    """(image_path, copied): copies every resolved file that the target folder lacks; runs in the executors, on folders all of them see."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import shutil
        import uuid

        for part in parts:
            done = []
            for path, root in zip(part["image_path"], part["root"], strict=True):
                to = os.path.join(target, path)
                fresh = not os.path.exists(to)
                if fresh:
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    part_file = f"{to}.{uuid.uuid4().hex}.part"
                    shutil.copy2(os.path.realpath(os.path.join(roots[int(root)], path)), part_file)
                    os.replace(part_file, to)
                done.append(fresh)
            yield pd.DataFrame({"image_path": part["image_path"], "copied": done})

    files = resolved.where("root is not null").select("image_path", "root").distinct()
    return files.mapInPandas(run, "image_path string, copied boolean")


def copy_counts(references: DataFrame, roots: list[str], target: str) -> DataFrame:
    """One row (copied, missing), one count for each reference: copies what the target lacks; a file already there counts as copied."""
    resolved = resolve(references, [listing(references.sparkSession, r) for r in roots])
    done = copy_missing(resolved, roots, target).groupBy("image_path").agg(F.count("*").alias("n"))
    (n,) = free(references, "n")
    x = resolved.select("image_path", "root").join(done.withColumnRenamed("n", n), "image_path", "left")
    return x.agg(F.count_if(F.col(n).isNotNull()).alias("copied"), F.count_if(F.col("root").isNull()).alias("missing"))
