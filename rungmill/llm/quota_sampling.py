"""A sample whose shares of each category match given targets (problem 5).

Cells (category, generator) are counted, each plan's size is split into integer quotas by largest remainder between a floor (the
stated minimum) and a cap (the rows there are), and each cell gives its rows with the smallest random keys. Keys are hashes of
the record, so a run can be repeated. No cell is sorted: a histogram over the leading digits of the keys finds the bucket in which
a quota ends, and only rows of that bucket are ranked, so a cell with a third of all rows is no hot spot.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungmill.functions.text import letters_digits
from rungmill.plans.staging import Staging

BUCKET_ROWS = 64  # rows of the largest cell in one bucket of keys, at least; buckets share 1 to MOST_DIGITS leading hex digits of the key
MOST_DIGITS = 5


def largest_remainder(weights: list[Fraction], total: int) -> list[int]:
    """Integers that add up to total in proportion to the weights; larger remainders are rounded up, earlier places first."""
    whole = sum(weights)
    if not whole or total <= 0:
        return [0] * len(weights)
    exact = [w * total / whole for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(exact)), key=lambda i: (out[i] - exact[i], i))[: total - sum(out)]:
        out[i] += 1
    return out


def allocate(shares: list[float], floors: list[int], caps: list[int], total: int) -> list[int]:
    """Quotas between min(floor, cap) and cap that add up to total, as nearly in proportion to the shares as these bounds let them.

    If the floors alone exceed the total, they are cut in proportion; if the caps are too small for it, every cap is met. Cells with a
    share of zero get their floor alone.
    """
    low = [min(f, c) for f, c in zip(floors, caps, strict=True)]
    if sum(low) >= total:
        return largest_remainder([Fraction(x) for x in low], total)
    share = [Fraction(s) for s in shares]
    out: list[int | None] = [None if s > 0 else lo for s, lo in zip(share, low, strict=True)]
    while free := [i for i, q in enumerate(out) if q is None]:
        rest = total - sum(q for q in out if q is not None)
        weight = sum(share[i] for i in free)
        ideal = {i: share[i] * rest / weight for i in free}
        under = [i for i in free if ideal[i] < low[i]]
        over = [i for i in free if ideal[i] > caps[i]]
        gap = sum(low[i] - ideal[i] for i in under) - sum(ideal[i] - caps[i] for i in over)
        if not under and not over:
            for i, q in zip(free, largest_remainder([share[i] for i in free], rest), strict=True):
                out[i] = q
        elif gap >= 0 and under:
            for i in under:
                out[i] = low[i]
        else:
            for i in over:
                out[i] = caps[i]
    return [int(q) for q in out]


_QUOTAS = "plan_id string, cat string, gen string, category string, generator_model string, target_rows long, min_rows long, available long, drawn long"


def _plan_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["cat", "gen"], kind="stable").reset_index(drop=True)
    total = int(pdf["n_rows"].iloc[0]) * int(pdf["sample_rows_per_mille"].max()) // 1000
    shares = [max(0.0, float(x)) for x in pdf["target_share"].fillna(0)]
    floors, caps = [int(x) for x in pdf["min_rows"].fillna(0)], [int(x) for x in pdf["available"]]
    pdf["target_rows"] = largest_remainder([Fraction(s) for s in shares], total)
    pdf["min_rows"] = floors
    pdf["drawn"] = allocate(shares, floors, caps, total)
    return pdf[["plan_id", "cat", "gen", "category", "generator_model", "target_rows", "min_rows", "available", "drawn"]]


def quotas(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: target_rows (share of the plan's size), min_rows, available and drawn rows.

    A plan's size is sample_rows_per_mille for each 1,000 records, rounded down. Categories and generators agree in letters and digits
    alone, ignoring case; records with a null in either, or of a cell without target, are in no cell but count for the size. Targets
    that are repeated in another spelling are one, with the sum of their shares and the larger minimum. Null shares and minimums are 0.
    """
    t = targets.where(F.col("plan_id").isNotNull() & F.col("category").isNotNull() & F.col("generator_model").isNotNull())
    t = t.groupBy("plan_id", letters_digits(F.col("category")).alias("cat"), letters_digits(F.col("generator_model")).alias("gen")).agg(
        F.min("category").alias("category"), F.min("generator_model").alias("generator_model"), F.sum("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"), F.max("sample_rows_per_mille").alias("sample_rows_per_mille")
    )
    counts = records.groupBy("category", "generator_model").agg(F.count("*").alias("n"))
    cells = counts.groupBy(letters_digits(F.col("category")).alias("cat"), letters_digits(F.col("generator_model")).alias("gen")).agg(F.sum("n").alias("available"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    t = t.join(cells, ["cat", "gen"], "left").fillna(0, ["available"]).crossJoin(F.broadcast(whole))  # one row
    t = t.withColumns({"sample_rows_per_mille": F.coalesce("sample_rows_per_mille", F.lit(0)), "min_rows": F.coalesce("min_rows", F.lit(0))})
    return t.groupBy("plan_id").applyInPandas(_plan_quotas, _QUOTAS)


def _digits(available: int) -> int:
    """Leading digits that tell buckets apart: no more than leave BUCKET_ROWS rows to a bucket, so that counting them combines rows."""
    d = 1
    while d < MOST_DIGITS and BUCKET_ROWS * 16 ** (d + 1) <= available:
        d += 1
    return d


def _quota_table(records: DataFrame, targets: DataFrame, stage: Staging) -> DataFrame:
    return stage.table(quotas(records, targets).coalesce(1), "quotas")


def sample(records: DataFrame, targets: DataFrame, ordinal: str = "record_ordinal", seed: int = 42) -> DataFrame:
    """(plan_id, ordinal, category, generator_model): the drawn records of each plan, under the spelling of the targets.

    Of each cell the records with the smallest keys are drawn, ties by ordinal. An empty table of records or targets gives an empty
    sample. Ordinals are taken to be unique.
    """
    stage = Staging(records.sparkSession, "sample")
    q = _quota_table(records, targets, stage)
    digits = _digits(q.agg(F.max("available")).first()[0] or 0)
    q = q.where("drawn > 0").select("plan_id", "cat", "gen", "category", "generator_model", "drawn")
    r = records.select(F.col(ordinal).alias("id"), letters_digits(F.col("category")).alias("cat"), letters_digits(F.col("generator_model")).alias("gen"))
    r = r.join(q, ["cat", "gen"])
    key = F.md5(F.concat_ws("|", "plan_id", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    r = r.select("plan_id", "cat", "gen", "category", "generator_model", "drawn", "id", key.alias("key")).withColumn("bucket", F.substring("key", 1, digits))
    cell = ["plan_id", "cat", "gen"]
    hist = r.groupBy(*cell, "bucket").agg(F.count("*").alias("n"), F.first("drawn").alias("drawn"))
    upto = F.sum("n").over(W.partitionBy(*cell).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    cuts = hist.withColumn("upto", upto).where((F.col("upto") >= F.col("drawn")) & (F.col("upto") - F.col("n") < F.col("drawn")))
    cuts = stage.table(cuts.select(*cell, F.col("bucket").alias("cut"), (F.col("drawn") - F.col("upto") + F.col("n")).alias("need")).coalesce(1), "cuts")
    r = r.join(cuts, cell)
    last = r.where("bucket = cut").withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy("key", "id"))).where("rank <= need").drop("rank")
    out = r.where("bucket < cut").unionByName(last)
    return out.select("plan_id", F.col("id").alias(ordinal), "category", "generator_model")


def shortfalls(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that could not be met: fewer rows drawn than the larger of share and minimum asks for.

    reason: 'unavailable' where the cell has too few rows, else 'displaced' where minimums of other cells took the room.
    """
    q = quotas(records, targets)
    asked = F.greatest("target_rows", "min_rows")
    q = q.where(F.col("drawn") < asked)
    reason = F.when(F.col("available") < asked, "unavailable").otherwise("displaced")
    return q.select("plan_id", "category", "generator_model", "target_rows", "min_rows", "available", "drawn", (asked - F.col("drawn")).alias("missing"), reason.alias("reason"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/metadata.parquet"), spark.read.parquet(f"{sf_dir}/sample_targets.parquet")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all plans from all of metadata."""
    return sample(*_tables(spark, sf_dir))


def p5_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets missed, of all plans."""
    return shortfalls(*_tables(spark, sf_dir))


def p5_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of all plans beside targets, minimums and availability."""
    return quotas(*_tables(spark, sf_dir)).drop("cat", "gen")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, n_rows: the size of each plan's sample."""
    return p5_sample(spark, sf_dir).groupBy("plan_id").agg(F.count("*").alias("n_rows"))


_BARE = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
QUERIES = {"p5_sample": p5_sample, "p5_shortfalls": p5_shortfalls, "p5_quotas": p5_quotas, "p5_totals": p5_totals}
#: Sizes alone; quotas between floors and caps are held against brute force in tests.
ORACLE = {
    "p5_totals": f"""
WITH c AS (SELECT {_BARE.format("category")} AS cat, {_BARE.format("generator_model")} AS gen, count(*) AS n FROM metadata WHERE category IS NOT NULL AND generator_model IS NOT NULL GROUP BY 1, 2),
t AS (SELECT plan_id, {_BARE.format("category")} AS cat, {_BARE.format("generator_model")} AS gen, max(sample_rows_per_mille) AS s FROM sample_targets GROUP BY 1, 2, 3)
SELECT plan_id, least(max((SELECT count(*) FROM metadata) * s // 1000), sum(coalesce(n, 0)))::BIGINT AS n_rows FROM t LEFT JOIN c USING (cat, gen) GROUP BY plan_id
""",
}
