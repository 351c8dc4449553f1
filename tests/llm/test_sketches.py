from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rungmill.llm import sketches


def _counts(batches):
    out = np.zeros(128, np.uint64)
    for b in batches:
        np.add.at(out, b.column("k").to_numpy() % 128, b.column("n").to_numpy().astype(np.uint64))
    return out


def test_counts_beyond_32_bits_over_many_partitions(spark, monkeypatch):
    """No task holds more partial chunks than it may, and nothing wraps."""
    df = spark.range(1000, numPartitions=1000).select(F.col("id").alias("k"), F.lit(1 << 30).cast("long").alias("n"))
    want = np.bincount(np.arange(1000) % 128, minlength=128).astype(np.uint64) << np.uint64(30)
    for fan in (32, 2):  # merged in one step, then in two
        monkeypatch.setattr(sketches, "FAN", fan)
        assert (sketches.gather(df, _counts, 128, np.uint64, lambda x: x) == want).all() and int(want.max()) > 1 << 32


def test_bitmap(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bits = sketches.gather_bits(df, 1 << 18, lambda b: [sketches.mix(b.column("key").to_numpy().view(np.uint64))])
    keys = sketches.mix(np.array([r[0] for r in df.collect()], np.int64).view(np.uint64))
    assert sketches.is_marked(bits, keys).all()
    assert sketches.is_marked(bits, sketches.mix(np.arange(10**5, dtype=np.uint64))).mean() < 0.01
    assert not sketches.is_marked(sketches.gather_bits(df.limit(0), 1000, lambda b: []), keys).any()
