"""Filling containers of fixed capacity with whole texts (problem 7).

Bulk-synchronous best-fit. Texts larger than the capacity are split into full pieces and a rest; everything else is placed whole. In
each round the pieces that still have no place and the gaps of open containers are sorted by size and cut into ranges, and each range is
swept on its own: from the largest piece down, pieces take the smallest gap of the range that holds them (its successor), and a gap
takes as many pieces of that size as fit. Ranges get wider from round to round, so tight matches come first and a piece at last meets
every larger gap. Then gaps are updated and the next round begins; when no piece fits any more, new containers open with the largest
pieces.

Which pieces of a size are meant is told by their ranks, so no two pieces claim the same room and rounds need no more than how many
pieces there are of each size: a table of at most capacity + 1 rows, whatever the input. The rounds are therefore planned on the driver
from these counts, as intervals of ranks, and carried out over all pieces in one pass: pieces are ranked once within (size, salt), with
as many salts as the size has PER_TASK pieces, so a size that a third of all pieces share is spread over tasks that grow with it, and
each looks up its container and place by size and rank.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungmill.plans.staging import Staging

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public GPT-2 splitting pattern (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
MOST_CAPACITY = 1 << 20  # bounds the counts and the plan that the driver holds
PER_TASK = 200_000  # pieces of one size that are ranked in one task, about
RANGES = (16, 4, 1)  # number of size ranges in the first rounds after containers open; then all sizes are one range


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) in tokens of a public byte-pair tokenizer; null texts have 0. The file is read here and travels with the job."""
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        code = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        for batch in batches:
            sizes = [0 if t is None else len(code.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


class _Plan:
    """Steps (size, first rank, rank after the last, pieces to a container, first container, place of a container's first piece)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {s: n for s, n in counts.items() if 0 < s < capacity and n}
        self.rank = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first container, containers, pieces in each)
        full = counts.get(capacity, 0)
        self.steps, self.containers = ([(capacity, 0, full, 1, 0, 0)] if full else []), full
        since = 0
        while self.left:
            ranges = RANGES[min(since, len(RANGES) - 1)]
            if self.gaps and self._round(-(-(capacity + 1) // ranges)):
                since += 1
            elif since and ranges > 1:  # tight matches are used up: look at wider ranges
                since += 1
            else:
                since = len(RANGES) if self.gaps or since else 1
                self._open()

    def _put(self, size: int, n: int, each: int, first: int, held: int, gap: int, into: dict) -> None:
        """n pieces of a size go to containers from the first on, each of them to each."""
        at = self.rank[size]
        self.steps.append((size, at, at + n, each, first, held))
        self.rank[size], self.left[size] = at + n, self.left[size] - n
        if not self.left[size]:
            del self.left[size]
        for k, start, some in ((n // each, first, each), (int(n % each > 0), first + n // each, n % each)):
            if k and gap > some * size:
                into.setdefault(gap - some * size, []).append((start, k, held + some))

    def _round(self, width: int) -> bool:
        """One sweep of every range; gaps that took a piece are back in the next round."""
        updated: dict[int, list[tuple[int, int, int]]] = {}
        before = len(self.steps)
        for low in range(0, self.capacity + 1, width):
            keys = sorted(g for g in self.gaps if low <= g < low + width)
            for size in sorted((s for s in self.left if low <= s < low + width), reverse=True):
                j = bisect.bisect_left(keys, size)
                while size in self.left and j < len(keys):
                    gap = keys[j]
                    each, groups = gap // size, self.gaps[gap]
                    first, k, held = groups.pop()
                    n = min(self.left[size], k * each)
                    used = -(-n // each)
                    if used < k:
                        groups.append((first + used, k - used, held))
                    self._put(size, n, each, first, held, gap, updated)
                    if not groups:
                        del self.gaps[gap], keys[j]
        for gap, groups in updated.items():
            self.gaps.setdefault(gap, []).extend(groups)
        return len(self.steps) > before

    def _open(self) -> None:
        """New containers for the largest pieces: as many as the pieces need by volume, and for all above half of the capacity."""
        volume = sum(s * n for s, n in self.left.items())
        need = max(-(-volume // self.capacity), sum(n for s, n in self.left.items() if s * 2 > self.capacity))
        for size in sorted(self.left, reverse=True):
            n = min(self.left[size], need)
            if n:
                self._put(size, n, 1, self.containers, 0, self.capacity, self.gaps)
                self.containers, need = self.containers + n, need - n


_PLACED = "doc_id long, piece long, n_tokens long, container long, place long"


def _look_up(plan):
    """The container and place of each piece by its size and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, starts = plan.value
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            some = size > 0
            at = np.searchsorted(starts, (size << np.int64(42)) + rank, "right") - 1
            step = steps[np.where(some, at, 0)] if len(steps) else np.ones((len(size), 6), np.int64)
            more = rank - step[:, 1]
            container, place = step[:, 4] + more // step[:, 3], step[:, 5] + more % step[:, 3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("size"), pa.array(container, pa.int64(), mask=~some), pa.array(place, pa.int64(), mask=~some)], ["doc_id", "piece", "n_tokens", "container", "place"])

    return run


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, container, place): where each document, or each piece of one larger than the capacity, goes.

    sizes: doc_id bigint (any value, unique), n_tokens bigint; it is read three times. Pieces of a split document are numbered from 0, all but
    the last are of full capacity. Containers are numbered from 0, place counts the pieces of one from 0 as they were put in. Documents
    without tokens take no room: one row with null container and place. Null and negative n_tokens count as 0. An empty table gives an
    empty result. The capacity may be from 1 to MOST_CAPACITY.
    """
    if not 1 <= capacity <= MOST_CAPACITY:
        raise ValueError(f"the capacity must be from 1 to {MOST_CAPACITY}")
    spark = sizes.sparkSession
    docs = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.expr(f"(n + {capacity - 1}) div {capacity}"), F.lit(1).cast("long")) - 1
    pieces = docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("long").alias("size"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    plan = _Plan(counts, capacity)
    steps = np.array(sorted(plan.steps), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast((steps, (steps[:, 0] << np.int64(42)) + steps[:, 1]))
    salts = spark.createDataFrame([(s, -(-n // PER_TASK)) for s, n in counts.items()], "s_size long, salts long")  # left to Spark's size check
    dealt = pieces.join(salts, F.col("size") == F.col("s_size")).select("doc_id", "piece", "size", F.pmod(F.xxhash64("doc_id", "piece"), "salts").alias("salt"))
    cells = dealt.groupBy("size", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(F.col("size").alias("c_size"), F.col("salt").alias("c_salt"), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = dealt.withColumn("inside", F.row_number().over(W.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(cells, (F.col("size") == F.col("c_size")) & (F.col("salt") == F.col("c_salt")))
    ranked = ranked.select("doc_id", "piece", "size", (F.col("before") + F.col("inside")).alias("rank"))
    return ranked.mapInArrow(_look_up(shared), _PLACED)


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = Staging(spark, "tokens")
    return fill_containers(stage.table(token_counts(docs), "sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers, tokens, the least number of containers that the tokens could need, and the share of room used."""
    x = p7_containers(spark, sf_dir).where("container is not null").agg(F.countDistinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return x.select("n_containers", "n_tokens", F.ceil(F.col("n_tokens") / CAPACITY).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 6).alias("used_share"))


def p7_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, placed, whole: whether each document has a place, and all of its tokens are in one container or it is larger than one."""
    x = p7_containers(spark, sf_dir).groupBy("doc_id").agg(F.count("container").alias("n"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("tokens"))
    return x.select("doc_id", (F.col("n") > 0).alias("placed"), ((F.col("n_pieces") == 1) | (F.col("tokens") > CAPACITY)).alias("whole"))


def p7_overfull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container, n_tokens: containers that hold more than their capacity, or places that two pieces share; there must be none."""
    x = p7_containers(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n"), F.count_distinct("place").alias("n_places"))
    return x.where((F.col("n_tokens") > CAPACITY) | (F.col("n") != F.col("n_places"))).select("container", "n_tokens")


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_documents": p7_documents, "p7_overfull": p7_overfull}
#: What must hold of any packing; which document is where has no SQL.
ORACLE = {
    "p7_documents": "SELECT doc_id, length(coalesce(text, '')) > 0 AS placed, TRUE AS whole FROM documents",
    "p7_overfull": "SELECT doc_id AS container, n_tokens FROM documents WHERE FALSE",
}
