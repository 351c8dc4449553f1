"""Pairs of records whose texts share most of their words (problem 1).

Adaptive multi-match prefixes. Words are ordered from rare to frequent. Two word sets that are similar enough share at least m words
in their prefixes if these are lengthened by m - 1 words, for every m. Each record chooses its own m: it estimates how many
candidates it would meet with m = 1, 2, ... and takes the cheapest. A record that would meet many others on single words thus
lengthens its prefix and demands that m words match together.

The demand is made before candidates arise: a join key is a combination of m prefix words, so a key shared is m words shared. The
longer record of a pair probes with keys of its own m; the shorter one offers keys for every m. A key also names the size of the
shorter word set: the place of the last of the m words tells how many words the longer record has passed without a match, hence
which sizes the other may still have. Records that would offer too many combinations offer single words under a key of their own, which
the longer records that chose a larger m probe as well, so nothing is capped.

Keys that have no partner are left out before the shuffle: bitmaps hold the keys offered and, then, those asked for. A bitmap has
BITS_PER_RECORD bits for each record; where this is more than KEY_BITS the keys are dealt to ranges, and each range has a pass and a
bitmap of its own, so bitmaps do not fill up as the table grows. A bitmap of each word set goes with its keys and rules out most
candidates within the join. Estimates come from counters of fixed size, less what other keys add to a counter on average. Collisions
in any of these cost candidates, never pairs.

Records of one word set are one class with one representative: copies do not multiply the join. Candidates are verified on the
whole sets. Words are compared as 64-bit hashes. Pairs come out for every two different texts; only many records of exactly one text
are stood for by their smallest id (near_duplicate_classes has who they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.text import words
from rungmill.llm.sketches import as_lists, bitmap_words, gather, gather_bits, is_marked, is_set, lists, mix, pack, places
from rungmill.plans.staging import Staging

WORD_COUNTERS = 1 << 22
KEY_COUNTERS = 1 << 22
WORD_SLOTS = 1 << 26  # of which two counts are told apart: once, more often
KEY_BITS, BITS_PER_RECORD = 1 << 29, 192  # the largest bitmap of one pass, and what a record needs: some 15 keys of four bits, a quarter of them set
ID_BITS = 1 << 26
MOST_WORDS = 2  # the largest m
MOST_OFFERS = 1024  # combinations of one m that a record offers; beyond, single words under a key of their own
EXACT_SIZES, SIZE_STEP = 32, 1.05  # sizes up to the first are told apart one by one, larger ones in classes of this ratio
SET_BITS = 40  # bits of a word set's bitmap that share a bigint with its table (4 bits) and number of words (20); 64 more follow
MOST_COUNTED = (1 << 20) - 1
KEY_COST = 0.05  # of looking up a key, against a row that a key meets in the join


class Similarity:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def probe_length(self, n: np.ndarray, m: int) -> np.ndarray:
        """Prefix words of the longer record of a pair."""
        return np.minimum(n, n + (-self.num * n) // self.den + m)

    def offer_length(self, n: np.ndarray, m: int) -> np.ndarray:
        """Prefix words of the shorter one."""
        short = np.minimum(n, n + (-2 * self.num * n) // (self.den + self.num) + m)
        return np.where(n < MOST_COUNTED, short, self.probe_length(n, m))  # beyond, which one is longer isn't told

    def most_words(self, n: np.ndarray) -> np.ndarray:
        """m must not exceed the words that any pair of this record shares."""
        return np.maximum(1, -((-self.num * n) // self.den))


def _rank(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits: exact below 2^15, then by their logarithm; the order is kept."""
    big = 32768 + 1024 * np.log2(np.maximum(counts, 32768) / 32768)
    return np.where(counts < 32768, counts, np.minimum(big, 65535)).astype(np.uint16)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    counts = np.zeros(WORD_COUNTERS, np.uint64)
    for batch in batches:
        values, _ = lists(batch.column("words"))
        np.add.at(counts, values.view(np.uint64) & np.uint64(WORD_COUNTERS - 1), np.uint64(1))
    return counts


def _word_repeats(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    seen = np.zeros(WORD_SLOTS, np.uint8)
    for batch in batches:
        at, n = np.unique(lists(batch.column("words"))[0].view(np.uint64) & np.uint64(WORD_SLOTS - 1), return_counts=True)
        seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2)
    return seen


def _size_class(n: np.ndarray) -> np.ndarray:
    n = np.minimum(n, MOST_COUNTED)
    return np.where(n <= EXACT_SIZES, n, EXACT_SIZES + (np.log(np.maximum(n, EXACT_SIZES) / EXACT_SIZES) / np.log(SIZE_STEP)).astype(np.int64))


def _prefixes(ranks, repeats, sim: Similarity, several):
    """Words that occur again, of the longest prefix that any m needs, in order, with their places; maybe: whether other records may have the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = ranks.value
        for batch in batches:
            values, n = lists(batch.column("words"))
            n = n.astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            rank = rank_of[values.view(np.uint64) & np.uint64(WORD_COUNTERS - 1)]
            order = np.lexsort((values, rank, doc))
            values = values[order]
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            keep = (place < np.repeat(sim.probe_length(n, MOST_WORDS), n)) & is_set(repeats.value, values.view(np.uint64) & np.uint64(WORD_SLOTS - 1))
            kept = np.bincount(doc[keep], minlength=len(n))
            slot = (mix(values.view(np.uint64)) >> np.uint64(32)) * np.uint64(SET_BITS + 64) // np.uint64(1 << 32)
            first = slot < np.uint64(SET_BITS)
            starts = np.cumsum(n) - n
            bits = np.bitwise_or.reduceat(np.where(first, np.uint64(0), np.uint64(1) << (np.where(first, slot, slot - np.uint64(SET_BITS)))), starts)
            table = batch.column("tbl").to_numpy(zero_copy_only=False).astype(np.uint64)
            card = np.bitwise_or.reduceat(np.where(first, np.uint64(1) << np.where(first, slot, np.uint64(0)), np.uint64(0)), starts) | (table << np.uint64(SET_BITS)) | (np.minimum(n, MOST_COUNTED).astype(np.uint64) << np.uint64(SET_BITS + 4))
            short = (mix(values[keep].view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)  # keys alone are made of these
            numbers = [pa.array(n, pa.int32()), pa.array(card.view(np.int64)), pa.array(bits.view(np.int64)), pa.array(is_marked(several.value, _ids(batch, "sig0")))]
            arrays = [as_lists(short, kept, pa.int32()), as_lists(place[keep].astype(np.int32), kept, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("tbl"), batch.column("id"), *numbers, *arrays], ["tbl", "id", "n", "card", "bits", "maybe", "prefix", "places"])

    return run


def _groups(starts: np.ndarray, tokens: np.ndarray, usable: np.ndarray):
    """Yields (k, rows, matrix): the first k words of each of the rows of which k words count."""
    for k in np.unique(usable):
        if k:
            rows = np.flatnonzero(usable == k)
            yield int(k), rows, tokens[starts[rows][:, None] + np.arange(k)[None, :]]


class _Keys:
    """Combinations of m prefix words of a batch of representatives: rows, keys without a size, and the place of the last word of each."""

    def __init__(self, batch: pa.RecordBatch, sim: Similarity):
        self.sim = sim
        self.n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
        values, lengths = lists(batch.column("prefix"))
        self.places = lists(batch.column("places"))[0].astype(np.int64)
        tbl = np.repeat(batch.column("tbl").to_numpy(zero_copy_only=False).astype(np.uint64), lengths)
        self.tokens = mix(values.view(np.uint32).astype(np.uint64) + ((tbl + np.uint64(1)) << np.uint64(40)))
        self.doc = np.repeat(np.arange(len(self.n)), lengths)
        self.starts = np.cumsum(lengths) - lengths

    def usable(self, length, m: int) -> np.ndarray:
        """How many words of each record's prefix for m count."""
        return np.bincount(self.doc[self.places < length(self.n, m)[self.doc]], minlength=len(self.n))

    def combine(self, usable: np.ndarray, m: int, most: int | None = None):
        """(rows, keys, places of the last words, rows with more than most combinations, which have none here)."""
        rows_out, keys_out, last_out, heavy = [], [], [], []
        for k, rows, matrix in _groups(self.starts, self.tokens, usable):
            if k < m:
                continue
            if most is not None and comb(k, m) > most:
                heavy.append(rows)
                continue
            at = np.array(list(combinations(range(k), m)))
            step = max(1, 200_000 // len(at))
            for chunk in range(0, len(rows), step):
                part, sub = rows[chunk : chunk + step], matrix[chunk : chunk + step]
                keys_out.append(mix(sub[:, at].sum(axis=2, dtype=np.uint64) + np.uint64(m)).ravel())
                rows_out.append(np.repeat(part, len(at)))
                last_out.append(self.places[self.starts[part][:, None] + at[:, -1][None, :]].ravel())
        both = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return both(rows_out, np.int64), both(keys_out, np.uint64), both(last_out, np.int64), both(heavy, np.int64)

    def offers(self):
        """(rows, keys) for every m, and single words under keys of their own for rows with too many combinations."""
        rows, keys, many = [], [], np.zeros(len(self.n), bool)
        for m in range(1, MOST_WORDS + 1):
            r, k, _, heavy = self.combine(self.usable(self.sim.offer_length, m), m, MOST_OFFERS if m > 1 else None)
            rows.append(r), keys.append(k)
            many[heavy] = True
        r, k, _, _ = self.combine(np.where(many, self.usable(self.sim.offer_length, 1), 0), 1)
        return np.concatenate([*rows, r]), np.concatenate([*keys, mix(k ^ _OWN)])

    def probes(self, counters: np.ndarray, noise: float):
        """(rows, keys, places of the last words, m) with the m that each record finds cheapest."""
        best, chosen, kept = np.full(len(self.n), np.inf), np.ones(len(self.n), np.int64), []
        for m in range(1, MOST_WORDS + 1):
            rows, keys, last, heavy = self.combine(self.usable(self.sim.probe_length, m), m, MOST_OFFERS if m > 1 else None)
            mine = last < self.sim.offer_length(self.n, m)[rows]
            met = counters[keys & np.uint64(KEY_COUNTERS - 1)].astype(np.float64) - mine - noise
            looked_up = np.bincount(rows, minlength=len(self.n))
            # Other keys in the same counters come and go by the root of their number; only what is surely more is a cost.
            cost = np.maximum(np.bincount(rows, met, minlength=len(self.n)) - 2 * np.sqrt(noise * looked_up), 0) + looked_up * KEY_COST
            cost[self.sim.most_words(self.n) < m] = np.inf
            cost[heavy] = np.inf
            better = cost < best
            best[better], chosen[better] = cost[better], m
            kept.append((rows, keys, last, np.full(len(rows), m)))
        rows, keys, last, size = (np.concatenate([x[j][chosen[x[0]] == m] for m, x in enumerate(kept, 1)]) for j in range(4))
        # The least size of a record with too many combinations; longer records that ask for more words probe its single words.
        least = np.arange(1, 4096)
        over = np.zeros(len(least), bool)
        for m in range(2, MOST_WORDS + 1):
            over |= np.array([comb(int(k), m) for k in self.sim.offer_length(least, m)], dtype=np.float64) > MOST_OFFERS
        bound = int(least[over][0]) if over.any() else 1 << 40
        r, k, p, _ = self.combine(np.where((chosen > 1) & (self.n >= bound), self.usable(self.sim.probe_length, 1), 0), 1)
        return np.concatenate([rows, r]), np.concatenate([keys, mix(k ^ _OWN)]), np.concatenate([last, p]), np.concatenate([size, np.ones(len(r), np.int64)])


_OWN = np.uint64(0xA24BAED4963EE407)  # turns the key of a single word into the one of records with too many combinations


def _sized(keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return mix(keys + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def _in_range(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Ranges of keys without sizes; a pass deals with one of them."""
    return (mix(keys) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == part


def _offers(batch: pa.RecordBatch, sim: Similarity, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    k = _Keys(batch, sim)
    rows, keys = k.offers()
    if parts > 1:
        mine = _in_range(keys, part, parts)
        rows, keys = rows[mine], keys[mine]
    return rows, _sized(keys, _size_class(k.n)[rows])


def _offer_counts(sim: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(KEY_COUNTERS, np.uint64)
        for batch in batches:
            counts += np.bincount((_Keys(batch, sim).offers()[1] & np.uint64(KEY_COUNTERS - 1)).astype(np.int64), minlength=KEY_COUNTERS).astype(np.uint64)
        return counts

    return run


def _seen_twice(sim: Similarity, n_words: int, part: int, parts: int):
    """Keys that are offered at all and, in every other word, keys that are offered more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * n_words, np.uint64)
        once, again = out[::2], out[1::2]
        for batch in batches:
            keys, times = np.unique(_offers(batch, sim, part, parts)[1], return_counts=True)
            more = (times > 1) | is_marked(once, keys)
            np.bitwise_or.at(again, *places(keys[more], n_words))
            np.bitwise_or.at(once, *places(keys, n_words))
        return out

    return run


def _merge_twice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x | y
    out[1::2] |= x[::2] & y[::2]
    return out


def _probes(batch: pa.RecordBatch, sim: Similarity, counters: np.ndarray, noise: float, offered: np.ndarray, part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys with a size) of this range of keys; keys that nobody else can have offered are left out."""
    k = _Keys(batch, sim)
    rows, keys, last, m = k.probes(counters, noise)
    if parts > 1:
        mine = _in_range(keys, part, parts)
        rows, keys, last, m = rows[mine], keys[mine], last[mine], m[mine]
    n = np.minimum(k.n, MOST_COUNTED)[rows]
    num, whole = sim.num, sim.num + sim.den
    least = -((-num * n) // sim.den)
    # n - last + m - 1 words at most are shared, and these are num / whole of both sizes at least.
    most = np.where(n < MOST_COUNTED, np.minimum(n, whole * (n - last + m - 1) // num - n), n)
    low, high = _size_class(least), _size_class(most)
    times = np.where(most >= least, high - low + 1, 0)
    own = (last < np.where(m == 1, sim.offer_length(k.n, 1)[rows], sim.offer_length(k.n, MOST_WORDS)[rows]))
    at = np.repeat(np.arange(len(rows)), times)
    size = np.repeat(low, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    sized = _sized(keys[at], size)
    mine = own[at] & (size == _size_class(k.n)[rows][at])  # the record may have offered this key itself
    hit = np.where(mine, False, is_marked(offered[::2], sized))
    hit[mine] = is_marked(offered[1::2], sized[mine])
    return rows[at][hit], sized[hit]


def _probe_rows(sim: Similarity, counters, noise, offered, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                rows, keys = _probes(some, sim, counters.value, noise, offered.value, part, parts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(some.column(c).take(pa.array(rows)) for c in ("id", "card", "bits"))], ["key", "long_id", "long", "long_bits"])

    return run


_PROBE, _OFFER = "key long, long_id long, long long, long_bits long", "key long, short_id long, short long, short_bits long"


def _met(marked):
    """The rows whose key is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(marked.value, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def _offer_rows(sim: Similarity, asked, part: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = _offers(batch, sim, part, parts)
            hit = is_marked(asked.value, keys)
            rows, keys = rows[hit], keys[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(batch.column(c).take(pa.array(rows)) for c in ("id", "card", "bits"))], ["key", "short_id", "short", "short_bits"])

    return run


def _ids(batch: pa.RecordBatch, id_: str) -> np.ndarray:
    tbl = batch.column("tbl").to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix(batch.column(id_).to_numpy(zero_copy_only=False).view(np.uint64) + tbl * np.uint64(0xD6E8FEB86659FD93))


def _only(marked, column: str):
    """The rows whose column, with its table, is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(marked.value, _ids(batch, column))))

    return run


def near_duplicate_pairs(texts: DataFrame, num: int = 7, den: int = 10, expand_limit: int = 64) -> DataFrame:
    """(tbl, id_a, id_b): pairs of one table whose sets of distinct words have at least num/den of their union in common.

    texts: tbl int below 16, id bigint (unique in its table), text string. Null texts and texts without words are in no pair. The smaller
    id stands first. All pairs appear, but for those of records with exactly one text: if these are more than expand_limit they appear
    with their smallest id, which stands for them in pairs with other texts (near_duplicate_classes lists them). Equal or short texts,
    ties and repeated words need no special care; an empty table gives an empty result.
    """
    spark = texts.sparkSession
    sim = Similarity(num, den)
    stage = Staging(spark, "near")
    share = spark.sparkContext.broadcast
    tbl = F.when(F.col("tbl").between(0, 15), F.col("tbl").cast("int")).otherwise(F.raise_error(F.lit("tbl must be from 0 to 15")).cast("int"))
    sets = texts.where(F.col("text").isNotNull()).select(tbl.alias("tbl"), F.col("id").cast("long").alias("id"), F.array_distinct(F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).alias("words"), F.xxhash64("text").alias("same"))
    part = lambda seed: F.aggregate("words", F.lit(0).cast("long"), lambda acc, x: (acc + F.pmod(F.xxhash64(F.lit(seed), x), F.lit((1 << 61) - 1))) % F.lit((1 << 61) - 1))
    sets = stage.table(sets.where(F.size("words") > 0).withColumns({"sig0": part(0), "sig1": part(1)}), "sets")
    ranks = share(gather(sets.select("words"), _word_counts, WORD_COUNTERS, np.uint64, _rank))
    repeats = share(gather(sets.select("words"), _word_repeats, WORD_SLOTS, np.uint8, lambda x: pack(x > 1), lambda x, y: np.minimum(x + y, 2)))
    # Word sets of more than one record; their other records are found by a bitmap, so that no other row is shuffled.
    several = stage.table(sets.groupBy("tbl", "sig0", "sig1").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "several")
    shared = share(gather_bits(several.select("tbl", "sig0"), ID_BITS, lambda batch: [_ids(batch, "sig0")]))
    shaped = sets.mapInArrow(_prefixes(ranks, repeats, sim, shared), "tbl int, id long, n int, card long, bits long, maybe boolean, prefix array<int>, places array<int>")
    shaped = stage.table(shaped.where((F.size("prefix") > 0) | F.col("maybe")), "shaped")
    members = sets.select("tbl", "sig0", "sig1", "same", "id").mapInArrow(_only(shared, "sig0"), "tbl int, sig0 long, sig1 long, same long, id long")
    members = stage.table(members.join(several, ["tbl", "sig0", "sig1"]).select("tbl", "rep", "same", "id", "copies"), "members")
    # One row for each class: its smallest id, or the only one.
    others = members.where("id != rep").select("tbl", "id")
    firsts = stage.table(shaped.where("maybe").join(others, ["tbl", "id"], "left_anti"), "firsts")
    small = shaped.where("not maybe").unionByName(firsts.select(*shaped.columns)).where(F.size("prefix") > 0).drop("maybe")
    counts = gather(small, _offer_counts(sim), KEY_COUNTERS, np.uint64, lambda x: np.minimum(x, (1 << 32) - 1).astype(np.uint32))
    noise, counts = float(counts.mean()), share(counts)
    bits = BITS_PER_RECORD * max(small.count(), 1024)
    passes = -(-bits // KEY_BITS)
    n_words = bitmap_words(-(-bits // passes))
    keys_of = lambda batch: [batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)]
    marks = lambda rows: share(gather_bits(rows.select("key"), n_words * 64, keys_of))
    probes = offers = None
    for k in range(passes):
        offered = share(gather(small, _seen_twice(sim, n_words, k, passes), 2 * n_words, np.uint64, lambda x: x, _merge_twice))
        asked = stage.table(small.mapInArrow(_probe_rows(sim, counts, noise, offered, k, passes), _PROBE), f"asked-{k}")
        offered.unpersist()
        given = stage.table(small.mapInArrow(_offer_rows(sim, marks(asked), k, passes), _OFFER), f"offers-{k}")
        asked = asked.mapInArrow(_met(marks(given)), _PROBE)
        probes, offers = (asked, given) if probes is None else (probes.unionByName(asked), offers.unionByName(given))
    n_long, n_short = F.shiftrightunsigned("long", SET_BITS + 4), F.shiftrightunsigned("short", SET_BITS + 4)
    tbl = F.shiftrightunsigned("short", SET_BITS).bitwiseAND(F.lit(15)).cast("int")
    fits = (n_short <= n_long) & (n_short * den >= n_long * num) & ((n_short < n_long) | (F.col("short_id") < F.col("long_id")))
    # Each bit in which two sets' bitmaps differ stands for a word that only one of them has.
    differ = F.bit_count(F.col("long").bitwiseXOR(F.col("short")).bitwiseAND(F.lit((1 << SET_BITS) - 1))) + F.bit_count(F.col("long_bits").bitwiseXOR(F.col("short_bits")))
    near = differ * (den + num) <= (n_long + n_short) * (den - num)
    candidates = stage.table(probes.join(offers, "key").where(fits & near).select(tbl.alias("tbl"), "long_id", "short_id").distinct(), "candidates")
    stage.drop("shaped", "firsts", *(f"{x}-{k}" for x in ("asked", "offers") for k in range(passes)))
    met = candidates.select("tbl", "long_id", "short_id")
    marked = spark.sparkContext.broadcast(gather_bits(met, ID_BITS, lambda batch: [_ids(batch, "long_id"), _ids(batch, "short_id")]))
    few_sets = sets.select("tbl", "id", "words").mapInArrow(_only(marked, "id"), "tbl int, id long, words array<long>")
    side = lambda name: few_sets.select("tbl", F.col("id").alias(f"{name}_id"), F.col("words").alias(f"{name}_words"))
    checked = candidates.join(side("long"), ["tbl", "long_id"]).join(side("short"), ["tbl", "short_id"])
    shared, total = F.size(F.array_intersect("long_words", "short_words")), F.size("long_words") + F.size("short_words")
    pairs = stage.table(checked.where(shared * (den + num) >= total * num).select("tbl", "long_id", "short_id"), "pairs")
    stage.drop("candidates", "sets", "several")

    many = members.where(F.col("copies") > expand_limit)
    equal = many.groupBy("tbl", "rep", "same").agg(F.min("id").alias("first"), F.count("*").alias("equal"))
    many = stage.table(many.join(equal, ["tbl", "rep", "same"]).select("tbl", "rep", "id", "first", "equal"), "many")
    shown = members.where(F.col("copies") <= expand_limit).select("tbl", "rep", "id").unionByName(many.where((F.col("equal") <= expand_limit) | (F.col("id") == F.col("first"))).select("tbl", "rep", "id"))
    as_side = lambda name: shown.select("tbl", F.col("rep").alias(f"{name}_id"), F.col("id").alias(f"{name}_member"))
    across = pairs.join(as_side("long"), ["tbl", "long_id"], "left").join(as_side("short"), ["tbl", "short_id"], "left")
    x, y = F.coalesce("long_member", "long_id"), F.coalesce("short_member", "short_id")
    across = across.select("tbl", F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"))
    inside = shown.select("tbl", "rep", F.col("id").alias("id_a")).join(shown.select("tbl", "rep", F.col("id").alias("id_b")), ["tbl", "rep"]).where("id_a < id_b").select("tbl", "id_a", "id_b")
    star = many.where((F.col("equal") > expand_limit) & (F.col("id") != F.col("first"))).select("tbl", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    return across.unionByName(inside).unionByName(star)


def near_duplicate_classes(texts: DataFrame, expand_limit: int = 64) -> DataFrame:
    """(tbl, id, class_id): the records of every text that more than expand_limit records of a table have, with their smallest id.

    In near_duplicate_pairs class_id stands for them: all of them are pairs of one another, and of whatever class_id is a pair of.
    """
    keyed = texts.where(F.col("text").isNotNull() & (F.size(words(F.col("text"))) > 0)).select("tbl", F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("same0"), F.xxhash64(F.lit(1), "text").alias("same1"))
    key = ["tbl", "same0", "same1"]
    large = keyed.groupBy(*key).agg(F.min("id").alias("class_id"), F.count("*").alias("equal")).where(F.col("equal") > expand_limit).select(*key, "class_id")
    return keyed.join(large, key).select("tbl", "id", "class_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, meta = spark.read.parquet(f"{sf_dir}/seeds.parquet"), spark.read.parquet(f"{sf_dir}/metadata.parquet")
    one = seeds.select(F.lit(0).alias("tbl"), F.col("record_ordinal").alias("id"), F.col("prompt_safe").alias("text"))
    return one.unionByName(meta.select(F.lit(1).alias("tbl"), F.col("record_ordinal").alias("id"), F.col("prompt_unsafe").alias("text")))


def _name() -> Column:
    return F.when(F.col("tbl") == 0, "seeds").otherwise("metadata").alias("table_name")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, id_a, id_b over all of seeds and metadata, at 0.7."""
    return near_duplicate_pairs(_texts(spark, sf_dir)).select(_name(), "id_a", "id_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, record_ordinal, class_ordinal of the equal prompts that p1_found has as pairs of their smallest ordinal alone."""
    return near_duplicate_classes(_texts(spark, sf_dir)).select(_name(), F.col("id").alias("record_ordinal"), F.col("class_id").alias("class_ordinal"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, query_ordinal, other_ordinal: for the records whose ordinal is divisible by 50, every other record of the table that is near."""
    x = near_duplicate_pairs(_texts(spark, sf_dir))
    both = x.unionByName(x.select("tbl", F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    return both.where(F.col("id_a") % 50 == 0).select(_name(), F.col("id_a").alias("query_ordinal"), F.col("id_b").alias("other_ordinal"))


QUERIES = {"p1_found": p1_found, "p1_classes": p1_classes, "p1_neighbours": p1_neighbours}
#: All records against those divisible by 50; holds as long as no text has more than 64 records, which no test table has.
ORACLE = {
    "p1_neighbours": r"""
WITH t AS (SELECT 'seeds' AS table_name, record_ordinal AS o, prompt_safe AS p FROM seeds UNION ALL SELECT 'metadata', record_ordinal, prompt_unsafe FROM metadata),
w AS (SELECT table_name, o, list_distinct(regexp_extract_all(lower(p), '[\p{L}\p{N}]+')) AS s FROM t WHERE p IS NOT NULL),
n AS (SELECT table_name, o, s, len(s) AS n FROM w WHERE len(s) > 0)
SELECT q.table_name, q.o AS query_ordinal, x.o AS other_ordinal FROM n q JOIN n x ON x.table_name = q.table_name AND x.o <> q.o AND q.o % 50 = 0 AND x.n * 10 >= q.n * 7 AND q.n * 10 >= x.n * 7
WHERE len(list_intersect(q.s, x.s)) * 17 >= (q.n + x.n) * 7
""",
}
