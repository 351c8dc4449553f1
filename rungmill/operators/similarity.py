"""Pairs of vectors of one category with a cosine similarity of at least a threshold.

Exact: the vectors of a category are dealt to tiles; every pair of tiles meets in one task, which multiplies two matrices and returns
the pairs above the threshold alone. A category with a third of all vectors is spread over the square of its tiles. Equal vectors
are one row with one representative, so copies do not multiply the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 4096


def cosine(a: str, b: str):
    """Cosine of two array columns in double precision; null if either norm is 0 or a side is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _tile_pairs(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        left, right = table.filter(pa.compute.equal(table["side"], 0)), table.filter(pa.compute.equal(table["side"], 1))
        both = table["tile_a"][0].as_py() == table["tile_b"][0].as_py()
        right = left if both else right
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        x, y = (np.stack(t["unit"].to_numpy(zero_copy_only=False)) for t in (left, right))
        ia, ib = left["id"].to_numpy(), right["id"].to_numpy()
        out = []
        for at in range(0, len(x), 1024):
            s = x[at : at + 1024] @ y.T
            i, j = np.nonzero(s >= threshold)
            ok = ia[at + i] < ib[j] if both else np.ones(len(i), bool)
            out.append((ia[at + i][ok], ib[j][ok], s[i, j][ok]))
        a, b, s = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return run


def cosine_edges(vectors: DataFrame, threshold: float, id_: str = "vec_id", category: str = "label", embedding: str = "embedding", tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b, similarity), a < b, of vectors of one category. Equal vectors are linked to the smallest of them, which stands for them.

    Null categories, null and empty vectors and vectors of norm 0 have no pair; vectors of different lengths in one category are compared
    with their own length only. An empty table gives an empty result.
    """
    norm = F.sqrt(F.aggregate(embedding, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    v = vectors.where(F.col(category).isNotNull() & F.col(embedding).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.concat_ws("|", F.col(category).cast("string"), F.size(embedding).cast("string")).alias("cat"), F.transform(embedding, lambda x: x.cast("double")).alias("e"), norm.alias("norm")).where("norm > 0")
    v = v.select("id", "cat", F.transform("e", lambda x: x / F.col("norm")).alias("unit"))
    reps = v.groupBy("cat", "unit").agg(F.min("id").alias("id"))
    tiles = reps.groupBy("cat").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles"))
    dealt = reps.join(tiles, "cat").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # Each row goes to every tile pair that its tile is in, never to every row.
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "tile").alias("tile_a"), F.greatest(t, "tile").alias("tile_b"), F.when(F.col("tile") <= t, 0).otherwise(1).alias("side")))
    dealt = dealt.select("cat", "id", "unit", F.inline(pairs))
    found = dealt.groupBy("cat", "tile_a", "tile_b").applyInArrow(_tile_pairs(threshold), "a long, b long, similarity double")
    copies = v.join(reps.withColumnRenamed("id", "rep"), ["cat", "unit"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return found.unionByName(copies)
