"""Records that differ in formatting alone (problem 2).

Every normalized field value is hashed together with its field name, and the hashes of a record are added up modulo a prime, which
ignores their order but not their number: a multiset hash. An attribute list (every part is ``name: value`` or ``name=value``)
counts as one pair for each part, so that the order of its parts has no effect. Records are grouped by two such sums, small rows
without any text; only records of groups with copies are read again, and their fields are compared as multisets, without sorting.

One content may hold a third of all rows: the grouping combines before its shuffle, and the comparison joins copies to one kept
record for each group, whose large side AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.text import letters_digits
from rungmill.llm.linking import connected_groups
from rungmill.plans.staging import Staging

_PRIME = (1 << 61) - 1  # sums of two residues stay below 2^63


def field_values(prompt: Column) -> Column:
    """The parts of an attribute list, or the whole text as one part; each in its letters and digits alone."""
    parts = F.filter(F.split(prompt, r"[;|\r\n]+"), lambda x: F.length(F.trim(x)) > 0)
    is_list = (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"(?s)^[^:=]*[:=]"))
    return F.when(is_list, F.transform(parts, letters_digits)).otherwise(F.array(letters_digits(prompt)))


def multiset_hash(name: str, values: Column, seed: int) -> Column:
    """The sum of the hashes of (name, value) pairs, modulo a prime."""
    one = lambda x: F.pmod(F.xxhash64(F.lit(f"{seed}:{name}"), x), F.lit(_PRIME))
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: (acc + one(x)) % F.lit(_PRIME))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values equally often; linear unless values repeat."""
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    flat = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    sets = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return sets & (flat | F.forall(F.array_distinct(a), lambda x: times(a, x) == times(b, x)))


def _round(stage: Staging, records: DataFrame, seed: int) -> DataFrame:
    """(ordinal, kept, same): records of one fingerprint with the smallest of them, and whether their fields agree."""
    sums = [((multiset_hash("category", F.array("cat"), s) + multiset_hash("prompt", F.col("parts"), s)) % F.lit(_PRIME)).alias(f"f{i}") for i, s in enumerate((2 * seed, 2 * seed + 1))]
    shown = records.select("ordinal", letters_digits(F.col("category")).alias("cat"), field_values(F.col("prompt")).alias("parts"), letters_digits(F.col("prompt")).alias("text"))
    sigs = stage.table(shown.select("ordinal", *sums, F.xxhash64(F.lit(seed), "cat", "text").alias("whole")), f"sigs-{seed}")
    kept = sigs.groupBy("f0", "f1").agg(F.min("ordinal").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stage.table(sigs.join(kept, ["f0", "f1"]).select("ordinal", "kept"), f"groups-{seed}")
    near = records.join(groups, "ordinal").select("ordinal", "kept", letters_digits(F.col("category")).alias("cat"), field_values(F.col("prompt")).alias("parts"))
    near = stage.table(near, f"near-{seed}")
    first = near.where("ordinal = kept").select("kept", F.col("cat").alias("kept_cat"), F.col("parts").alias("kept_parts"))
    pairs = near.where("ordinal != kept").join(first, "kept")
    return stage.table(pairs.select("ordinal", "kept", ((F.col("cat") == F.col("kept_cat")) & same_multiset(F.col("parts"), F.col("kept_parts"))).alias("same")), f"pairs-{seed}")


def formatting_copies(records: DataFrame, ordinal: str, category: str, prompt: str) -> DataFrame:
    """(kept_ordinal, copy_ordinal): one row for each record whose content a record with a smaller ordinal has.

    Contents are equal when category and prompt agree in letters and digits alone, ignoring case, or when both prompts are
    attribute lists whose parts agree so in any order; this is closed over chains. A null in either field takes no part. Empty
    fields and fields without letters and digits are equal to each other. Records of equal fingerprint whose fields differ are
    grouped again under other hashes until none is left. Ordinals are taken to be unique; other columns have no effect.
    """
    stage = Staging(records.sparkSession, "copies")
    base = records.where(F.col(category).isNotNull() & F.col(prompt).isNotNull()).select(F.col(ordinal).cast("long").alias("ordinal"), F.col(category).alias("category"), F.col(prompt).alias("prompt"))
    found, left, seed = [], base, 0
    while True:
        pairs = _round(stage, left, seed)
        found.append(pairs.where("same").select("kept", F.col("ordinal").alias("copy")))
        differ = pairs.where("not same")
        if not differ.limit(1).count():
            break
        left, seed = base.join(differ.select("ordinal"), "ordinal", "left_semi"), seed + 1
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    # The same letters in the same order, split into other parts, are the same content too. Such records are rare: they link groups.
    sigs = records.sparkSession.read.parquet(f"{stage.base}/sigs-0")
    split = sigs.groupBy("whole").agg(F.min("f0").alias("x"), F.max("f0").alias("y"), F.min("ordinal").alias("kept")).where("x != y").select("whole", "kept")
    if split.limit(1).count() or len(found) > 1:
        odd = sigs.join(split, "whole").where("ordinal != kept").select("kept", F.col("ordinal").alias("copy"))
        odd = base.join(odd, base["ordinal"] == odd["copy"]).select("kept", "copy", "category", "prompt")
        odd = odd.join(base.select(F.col("ordinal").alias("kept"), F.col("category").alias("c2"), F.col("prompt").alias("p2")), "kept")
        agree = (letters_digits(F.col("category")) == letters_digits(F.col("c2"))) & (letters_digits(F.col("prompt")) == letters_digits(F.col("p2")))
        links = connected_groups(links.unionByName(odd.where(agree).select("kept", "copy")), "kept", "copy").where("node != group").select(F.col("group").alias("kept"), F.col("node").alias("copy"))
    return links.select(F.col("kept").alias("kept_ordinal"), F.col("copy").alias("copy_ordinal"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept_ordinal, copy_ordinal over all of metadata."""
    return formatting_copies(spark.read.parquet(f"{sf_dir}/metadata.parquet"), "record_ordinal", "category", "prompt_unsafe")


def p2_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept_ordinal, n_records: contents that occur more than once, with the number of their records."""
    return p2_found(spark, sf_dir).groupBy("kept_ordinal").agg((F.count("*") + 1).alias("n_records"))


_CONTENT = r"""
WITH r AS (SELECT record_ordinal AS o, regexp_replace(lower(category), '[^\p{L}\p{N}]+', '', 'g') AS c,
                  list_filter(regexp_split_to_array(prompt_unsafe, '[;|\r\n]+'), lambda x: length(trim(x)) > 0) AS parts, prompt_unsafe AS p
           FROM metadata WHERE category IS NOT NULL AND prompt_unsafe IS NOT NULL),
k AS (SELECT o, c, CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda x: NOT regexp_matches(x, '(?s)^[^:=]*[:=]'))) = 0
             THEN list_sort(list_transform(parts, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')))
             ELSE [regexp_replace(lower(p), '[^\p{L}\p{N}]+', '', 'g')] END AS v FROM r),
g AS (SELECT o, min(o) OVER (PARTITION BY c, v) AS kept FROM k)
"""
QUERIES = {"p2_found": p2_found, "p2_copy_counts": p2_copy_counts}
ORACLE = {
    "p2_found": _CONTENT + "SELECT kept AS kept_ordinal, o AS copy_ordinal FROM g WHERE o <> kept",
    "p2_copy_counts": _CONTENT + "SELECT kept AS kept_ordinal, CAST(count(*) AS BIGINT) AS n_records FROM g GROUP BY kept HAVING count(*) > 1",
}
