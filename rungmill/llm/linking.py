"""Groups of records that are linked directly or through others (problem 4).

Deterministic Borůvka hooking. Edges are ordered by (smaller end, larger end), so every component has one smallest outgoing edge,
which leads to its smallest neighbour. Hooking along these edges gives trees whose only cycles are mutual pairs; the smaller of
such a pair is the root, and it is the smallest label of its tree. Pointer doubling collapses the trees, edges are relabelled and
deduplicated, and this repeats until no edge is left: the number of components at least halves each time.

Nothing is collected but counts. Rounds are written tables, so a lost executor costs no more than the current job. A hub with a
third of all edges is one row after the first round; before, its side of a join is split by AQE's skew handling, and minima
combine before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.text import letters_digits
from rungmill.plans.staging import Staging

_JUMPS = 3  # joins of one doubling job; each such job shortens paths to about a quarter


def _collapse(stage: Staging, hooks: DataFrame, name: str) -> DataFrame:
    """(c, p): parents that may form trees and mutual pairs; out comes (c, root)."""
    other = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    tree = hooks.join(other, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    k = 0
    tree = stage.table(tree.withColumn("moved", F.lit(True)), f"{name}-{k}")
    while True:
        step = tree.drop("moved")
        for j in range(_JUMPS):
            to = tree.select(F.col("c").alias("at"), F.col("p").alias(f"p{j}"))
            last = "p" if j == 0 else f"p{j - 1}"
            step = step.join(to, step[last] == to["at"], "left").drop("at")
        end = F.col(f"p{_JUMPS - 1}")
        k += 1
        tree = stage.table(step.select("c", end.alias("p"), (end != F.col(f"p{_JUMPS - 2}")).alias("moved")), f"{name}-{k}")
        stage.drop(f"{name}-{k - 1}")
        if not tree.where("moved").limit(1).count():
            return tree.drop("moved")


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): for each node of an edge, the smallest node that it is linked with directly or indirectly.

    edges: two bigint columns; other columns are ignored. Rows with a null end and self pairs link nothing and name no node;
    repeated rows and either order are one edge. No edge gives an empty table.
    """
    spark = edges.sparkSession
    stage = Staging(spark, "groups")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    e = edges.where((x != y)).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()
    e = stage.table(e, "edges-0")
    maps: list[DataFrame] = []
    while e.limit(1).count():
        k = len(maps)
        both = e.select(F.col("u").alias("c"), F.col("v").alias("o")).unionAll(e.select("v", "u"))
        hooks = stage.table(both.groupBy("c").agg(F.min("o").alias("p")), f"hooks-{k}")
        maps.append(_collapse(stage, hooks, f"tree-{k}"))
        stage.drop(f"hooks-{k}")
        to = maps[-1]
        ends = e.join(to.select(F.col("c").alias("u"), F.col("p").alias("pu")), "u").select("v", "pu")
        ends = ends.join(to.select(F.col("c").alias("v"), F.col("p").alias("pv")), "v").where("pu != pv")
        e = stage.table(ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), f"edges-{k + 1}")
        stage.drop(f"edges-{k}")
    if not maps:
        return spark.createDataFrame([], "node long, group long")
    out = maps.pop()
    while maps:
        far = out.select(F.col("c").alias("p"), F.col("p").alias("root"))
        out = maps.pop().join(far, "p", "left").select("c", F.coalesce("root", "p").alias("p"))
    return out.select(F.col("c").alias("node"), F.col("p").alias("group"))


def valid_links(pairs: DataFrame, records: DataFrame, min_score: float) -> DataFrame:
    """(a, b) of the pairs that link two different known records of one category with a score of at least min_score.

    Categories agree in letters and digits alone, ignoring case; null categories, scores and ends, and NaN scores link nothing.
    """
    lo, hi = F.least("record_a", "record_b"), F.greatest("record_a", "record_b")
    p = pairs.where((F.col("score") >= min_score) & ~F.isnan("score") & (F.col("record_a") != F.col("record_b")))
    p = p.select(lo.alias("a"), hi.alias("b")).distinct()
    cats = records.where(F.col("category").isNotNull()).select("record_ordinal", letters_digits(F.col("category")).alias("cat"))
    p = p.join(cats.select(F.col("record_ordinal").alias("a"), F.col("cat").alias("cat_a")), "a")
    p = p.join(cats.select(F.col("record_ordinal").alias("b"), F.col("cat").alias("cat_b")), "b")
    return p.where("cat_a = cat_b").select("a", "b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_ordinal, group_ordinal over all of match_pairs."""
    pairs, meta = spark.read.parquet(f"{sf_dir}/match_pairs.parquet"), spark.read.parquet(f"{sf_dir}/metadata.parquet")
    groups = connected_groups(valid_links(pairs, meta, 0.95))
    return groups.select(F.col("node").alias("record_ordinal"), F.col("group").alias("group_ordinal"))


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p4_found(spark, sf_dir).groupBy("group_ordinal").agg(F.count("*").alias("n_records"))
    return sizes.groupBy("n_records").agg(F.count("*").alias("n_groups"))


_GROUPS = r"""
WITH RECURSIVE cats AS (SELECT record_ordinal, regexp_replace(lower(category), '[^\p{L}\p{N}]+', '', 'g') AS cat FROM metadata WHERE category IS NOT NULL),
e AS (SELECT DISTINCT least(record_a, record_b) AS u, greatest(record_a, record_b) AS v FROM match_pairs
      JOIN cats x ON x.record_ordinal = record_a JOIN cats y ON y.record_ordinal = record_b
      WHERE score >= 0.95 AND NOT isnan(score) AND record_a <> record_b AND x.cat = y.cat),
ways AS (SELECT u AS c, v AS o FROM e UNION ALL SELECT v, u FROM e),
low AS (SELECT c, least(c, min(o)) AS m FROM ways GROUP BY c),
reach(c, m) AS (SELECT c, m FROM low WHERE c = m
                UNION SELECT w.o, r.m FROM reach r JOIN ways w ON w.c = r.c WHERE w.o > r.m),
g AS (SELECT c AS record_ordinal, min(m) AS group_ordinal FROM reach GROUP BY c)
"""
QUERIES = {"p4_found": p4_found, "p4_group_sizes": p4_group_sizes}
ORACLE = {
    "p4_found": _GROUPS + "SELECT record_ordinal, group_ordinal FROM g",
    "p4_group_sizes": _GROUPS + "SELECT n AS n_records, CAST(count(*) AS BIGINT) AS n_groups FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM g GROUP BY group_ordinal) GROUP BY n",
}
