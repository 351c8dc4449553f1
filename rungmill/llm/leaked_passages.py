"""Passages of held-out items inside a corpus (problem 8).

Spaced seeds: a mask looks at some words of a window and ignores the others, so a window is found even if ignored words were
replaced. Masked windows of items and documents are joined on their hashes; of each hit the two texts are compared word by word along
the whole diagonal, which gives the longest run of equal words and, tolerating single replaced words, all overlaps.

Some mask spans no more words than the shortest passage reported, so every such passage has a hit. Which overlaps with replaced words are
found depends on the masks: OVERLAP_MASKS have a hit wherever every n-th word is replaced, for any n from two on, and in at least 95 % of
overlaps of twenty words in which a word after an equal one is replaced with a chance of up to one third (measured in tests). Documents
emit only windows whose hash is in a bitmap of all item windows, which has a fixed size; the join after it is exact. Only documents with
such a window are written and shuffled, and of these no more than the words that lie opposite an item are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.text import words
from rungmill.llm.sketches import as_lists, gather_bits, is_marked, lists, mix
from rungmill.plans.staging import Staging

MASKS = ("1101100111", "1110011011")  # 1: the word counts; each ignores three of ten
OVERLAP_MASKS = ("1111011", "1110111", "11011011", "10101010101")
BITS = 1 << 26
MOST_SENT = 1 << 18  # words of items that are sent to every task; with more of them the joins shuffle


def _windows(batch: pa.RecordBatch, masks: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, key) of all masked windows, mask by mask."""
    values, n = lists(batch.column("words"))
    tokens, n = mix(values.view(np.uint64)), n.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    left = np.repeat(n, n) - place
    for k, mask in enumerate(masks):
        at = np.flatnonzero(left >= len(mask))
        key = np.full(len(at), np.uint64(k + 1))
        for j, bit in enumerate(mask):
            if bit == "1":
                key = key * np.uint64(0x9E3779B97F4A7C15) + tokens[at + j]
        yield row[at], place[at], mix(key)


def _offered(masks: tuple[str, ...]):
    """The windows of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, key in _windows(batch, masks):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id").take(pa.array(row)), pa.array(place, pa.int64())], ["key", "item_id", "item_at"])

    return run


def _with_hits(masks: tuple[str, ...], marked):
    """The documents that have windows whose keys are marked, with these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row, place, key in _windows(batch, masks):
                hit = is_marked(marked.value, key)
                found.append((row[hit], place[hit], key[hit]))
            row, place, key = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(row, kind="stable")
            rows, n = np.unique(row, return_counts=True)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("words").take(at), as_lists(key[order].view(np.int64), n, pa.int64()), as_lists(place[order], n, pa.int64())], ["doc_id", "words", "keys", "places"])

    return run


_OVERLAP = "doc_id long, item_id long, longest_run int, matched_words int, item_words int"


def _compare(least: int):
    """Of a diagonal's overlaps (runs with no two replaced words in a row) of so many equal words: the longest run, and the equal words of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (dv, dn), (iv, im) = lists(batch.column("part")), lists(batch.column("item_words"))
            dn, first = dn.astype(np.int64), batch.column("first").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), dn)
            equal = iv[np.repeat(np.cumsum(im) - im + first - np.cumsum(dn) + dn, dn) + np.arange(len(dv))] == dv
            total, runs = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            if equal.any():
                new = np.concatenate([[True], row[1:] != row[:-1]])
                start = np.flatnonzero(equal & (new | ~np.concatenate([[False], equal[:-1]])))
                end = np.flatnonzero(equal & (np.concatenate([new[1:], [True]]) | ~np.concatenate([equal[1:], [False]]))) + 1
                chains = np.flatnonzero(np.concatenate([[True], (start[1:] - end[:-1] > 1) | (row[start[1:]] != row[start[:-1]])]))
                sums, longest = (f.reduceat(end - start, chains) for f in (np.add, np.maximum))
                of = row[start[chains]]
                np.maximum.at(total, of, sums.astype(np.int32))
                np.maximum.at(runs, of, np.where(sums >= least, longest, 0).astype(np.int32))
            keep = pa.array(total >= least)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(runs, pa.int32()), pa.array(total, pa.int32()), pa.array(im, pa.int32())], ["doc_id", "item_id", "longest_run", "matched_words", "item_words"])
            yield out.filter(keep)

    return run


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 10, masks: tuple[str, ...] = OVERLAP_MASKS) -> DataFrame:
    """(doc_id, item_id, longest_run, matched_words, item_words): documents that hold a passage of an item.

    documents: doc_id, text; items: item_id, text. longest_run is the longest row of consecutive equal words in an overlap, matched_words counts the
    equal words of the best overlap, in which single words may be replaced; overlaps with fewer than ``least`` equal words are left out,
    and so are those that fit no mask anywhere (see above). Of several overlaps of one document and item the longest run and the most equal words count, each by itself. Words are compared as
    64-bit hashes, whatever stands between them. Null and empty texts and items of fewer words than a mask spans have no overlap. Ids are taken
    to be unique.
    """
    spark = documents.sparkSession
    stage = Staging(spark, "leaks")
    hashed = lambda df, name: df.where(F.col("text").isNotNull()).select(F.col(name).cast("long").alias("id"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("words"))
    docs, tests = hashed(documents, "doc_id"), stage.table(hashed(items, "item_id"), "items")
    few = (tests.agg(F.sum(F.size("words"))).first()[0] or 0) <= MOST_SENT
    sent = F.broadcast if few else lambda df: df
    marked = spark.sparkContext.broadcast(gather_bits(tests.select("words"), BITS, lambda batch: (key for _, _, key in _windows(batch, masks))))
    asked = tests.mapInArrow(_offered(masks), "key long, item_id long, item_at long")
    met = stage.table(docs.mapInArrow(_with_hits(masks, marked), "doc_id long, words array<long>, keys array<long>, places array<long>"), "met")
    hits = met.select("doc_id", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("doc_at"))))
    hits = hits.join(sent(asked), "key").select("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    # What lies opposite the item is cut out as soon as the document is met, so a hit never carries a whole document.
    hits = hits.join(sent(tests.select(F.col("id").alias("item_id"), F.size("words").alias("size"))), "item_id")
    shift = F.col("shift").cast("int")
    part = F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.greatest(F.col("size") + F.least(shift, F.lit(0)), F.lit(0)))
    hits = hits.join(met.select("doc_id", "words"), "doc_id").select("doc_id", "item_id", part.alias("part"), F.greatest(-shift, F.lit(0)).alias("first"))
    hits = hits.join(sent(tests.select(F.col("id").alias("item_id"), F.col("words").alias("item_words"))), "item_id")
    found = hits.mapInArrow(_compare(least), _OVERLAP)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("longest_run", "matched_words", "item_words")))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/eval_items.parquet").select("item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id: at least ten consecutive words of the item, over all documents."""
    return leaked_passages(*_tables(spark, sf_dir), masks=MASKS).where("longest_run >= 10").select("doc_id", "item_id")


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with overlaps of at least ten equal words, single replaced words tolerated: longest run, best overlap and its share of the item."""
    x = leaked_passages(*_tables(spark, sf_dir))
    return x.select("doc_id", "item_id", "longest_run", "matched_words", F.round(F.col("matched_words") / F.col("item_words"), 4).alias("item_share"))


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))


_RUNS = r"""
WITH d AS (SELECT doc_id, w, i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i)),
e AS (SELECT item_id, w, i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i)),
dg AS (SELECT doc_id, hash(list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS g, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM d),
eg AS (SELECT item_id, hash(list(w) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) AS g, count(*) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS n FROM e),
p AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g) WHERE dg.n = 10 AND eg.n = 10)
"""
QUERIES = {"p8_found": p8_found, "p8_overlaps": p8_overlaps, "p8_leaked_items": p8_leaked_items}
ORACLE = {
    "p8_found": _RUNS + "SELECT doc_id, item_id FROM p",
    "p8_leaked_items": _RUNS + "SELECT item_id, CAST(count(*) AS BIGINT) AS n_documents FROM p GROUP BY item_id",
}
