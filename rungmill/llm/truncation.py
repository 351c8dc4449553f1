"""Texts that lost their end by a limit of the field or a broken transfer (problem 6).

Limits: the length of every text is computed as different stores would count it (characters, UTF-8 bytes, UTF-16 units, with
entities or JSON escapes, with CRLF line ends). Texts are counted by source and length under each of these; a hidden limit is a
length that far more texts have than the lengths just below, with hardly any text above. Of the encodings that show this limit of a
source the one that gathers most texts there is the right one. A source whose field was widened, or of which only some texts pass a
narrow store, has longer texts as well: there a limit is a length that far more different texts have than the lengths around it, and
nearly all of them stop without an end. A source may have several limits.

Endings: a broken transfer cuts anywhere. All texts are read as tokens (rare words by their last letters, numbers by their digits),
and each short context of tokens has a rate at which texts end in it. An ending whose context hardly ever ends a text, or whose
last word or number ends as hardly any does in the middle of texts, is a cut. Rates are counted over the different texts of the
table (equal tokens are one text, however often it is delivered) in arrays of fixed size; texts at a limit don't count as ends. What a
text holds itself is taken out before it is judged, and a rate counts only if the context was seen often enough to show one as low.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungmill.llm.sketches import gather, lists, mix
from rungmill.plans.staging import Staging

COUNTERS = 1 << 22
WORD_COUNTERS = 1 << 20
KNOWN_SHARE, KNOWN_LEAST = 2e-4, 8  # a word is known if so many texts hold it
LEAST_SEEN = 30  # the last letters of a word or number seen less often tell nothing
END_RATE = 0.004  # texts hardly ever end in a context with a lower rate; one that other texts hold less than 1 / END_RATE times gives way to a shorter one
LAST_WORD_RATE = 0.001  # nor with a last word of a lower rate, whatever stands before it
LAST_SHARE = 0.0015  # names and numbers hardly ever end in a way with a lower share
SPIKE, SPIKE_LEAST, LONGER = 6.0, 5, 0.002  # a limit: times the texts of the lengths below it, texts at least, share of longer texts at most
DIFFERENT_LEAST, UNFINISHED = 20, 0.9  # a limit below longer texts: different texts at least, and the share of them that don't end a sentence
ECHO = 12  # lengths this near to a limit of the same source with more texts are taken for that limit in another encoding
#: Marks that end a sentence or a quotation (fixed values).
FINAL = r"[.!?。！？…]['\"”’»)\]]*\s*$"


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text as different stores count it."""
    chars, utf8 = F.char_length(text).cast("long"), F.octet_length(text).cast("long")
    times = lambda pattern: (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")
    astral, beyond = times(r"[\x{10000}-\x{10FFFF}]"), times(r"[^\x00-\x7F]")
    escapes = times(r"[\"\\\x08\x0C\n\r\t]") + 5 * times(r"[\x00-\x07\x0B\x0E-\x1F]")
    crlf = F.char_length(F.regexp_replace(text, r"(?<!\r)\n", "\r\n")).cast("long") - chars
    entities = 4 * times("&") + 3 * times("[<>]") + 5 * times('"') + 4 * times("'")
    return {
        "characters": chars,
        "utf8": utf8,
        "utf16": chars + astral,
        "entities": chars + entities,
        "entities_utf8": utf8 + entities,
        "json": chars + escapes + 5 * beyond + 6 * astral,
        "json_utf8": utf8 + escapes,
        "crlf": chars + crlf,
        "crlf_utf8": utf8 + crlf,
    }


def limits(texts: DataFrame) -> DataFrame:
    """(tbl, source, encoding, limit, at_limit): the hidden limits of each source, with the number of its texts there.

    texts: tbl, source, text. Null sources are one source. Empty texts show no limit. Of lengths less than
    ECHO + 1 apart, in whatever encodings, the one with most texts is given.
    """
    names = {k: c for k, c in lengths(F.col("text")).items()}
    unfinished = F.when(~F.col("text").rlike(FINAL), 1).otherwise(0)
    wide = texts.where(F.col("text").isNotNull()).select("tbl", "source", F.xxhash64("text").alias("same"), unfinished.alias("unfinished"), *[c.alias(k) for k, c in names.items()])
    wide = wide.groupBy("tbl", "source", "same").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("unfinished", *names)))
    counts = wide.unpivot(["tbl", "source", "copies", "unfinished"], list(names), "encoding", "n")
    counts = counts.groupBy("tbl", "source", "encoding", "n").agg(F.sum("copies").alias("at_limit"), F.count("*").alias("different"), F.sum("unfinished").alias("unfinished"))
    w = W.partitionBy("tbl", "source", "encoding").orderBy("n")
    around = lambda x, lo, hi: F.coalesce(F.sum(x).over(w.rangeBetween(lo, hi)), F.lit(0))
    counts = counts.withColumns({
        "below": around("at_limit", -10, -1),
        "near": F.greatest(around("different", -10, -1), around("different", 1, 10)),
        "upto": F.sum("at_limit").over(w.rangeBetween(W.unboundedPreceding, 0)),
        "all": F.sum("at_limit").over(W.partitionBy("tbl", "source", "encoding")),
    })
    spike = (F.col("at_limit") >= SPIKE_LEAST) & (F.col("at_limit") * 10 >= SPIKE * F.col("below")) & (F.col("all") - F.col("upto") <= LONGER * F.col("all")) & (F.col("n") > 1) & (F.col("at_limit") < 0.9 * F.col("all"))
    inside = (F.col("different") >= DIFFERENT_LEAST) & (F.col("different") * 10 >= SPIKE * F.col("near")) & (F.col("unfinished") >= UNFINISHED * F.col("different")) & (F.col("n") > 1)
    order = F.array_position(F.array(*[F.lit(k) for k in names]), F.col("encoding"))
    found = counts.where(spike | inside).withColumn("last", spike)
    best = W.partitionBy("tbl", "source", "last").orderBy(F.desc("at_limit"), order, F.desc("n"))
    found = found.withColumn("place", F.row_number().over(best)).where("not last or place = 1")
    # Texts cut by one encoding have nearly that length in others too; the length with most texts explains those around it.
    mine = F.struct(F.col("last").cast("int").alias("a"), F.col("at_limit").alias("b"), (-order).alias("c"), F.col("n").alias("d"))
    around = W.partitionBy("tbl", "source").orderBy("n").rangeBetween(-ECHO, ECHO)
    return found.withColumns({"mine": mine, "best": F.max(mine).over(around)}).where("mine = best").select("tbl", "source", "encoding", F.col("n").alias("limit"), "at_limit")


_TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\s_]"


def _tokens(texts: DataFrame) -> DataFrame:
    """Adds tokens as hashes, and their last letters (a hash) or number of digits (negative)."""
    found = F.regexp_extract_all(F.lower(F.col("text")), F.lit(_TOKEN), F.lit(0))
    last = lambda t: F.when(t.rlike(r"^\p{N}"), -F.char_length(t).cast("long")).otherwise(F.abs(F.xxhash64(F.right(t, F.lit(2)))).cast("long"))
    texts = texts.withColumn("found", found)
    return texts.withColumns({"tokens": F.transform("found", lambda t: F.xxhash64(t)), "lasts": F.transform("found", last)}).drop("found", "text")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    counts = np.zeros(WORD_COUNTERS, np.uint64)
    for batch in batches:
        values, n = lists(batch.column("tokens"))
        np.add.at(counts, values.view(np.uint64) & np.uint64(WORD_COUNTERS - 1), 1)
    return counts


_K = np.uint64(0x9E3779B97F4A7C15)


def _contexts(batch: pa.RecordBatch, known: np.ndarray):
    """(contexts of three lengths, key and whole of the last letters or digits, whether a token is its text's last, index of each text's last token)."""
    values, n = lists(batch.column("tokens"))
    lasts, _ = lists(batch.column("lasts"))
    n = n.astype(np.int64)
    tbl = np.repeat(batch.column("tbl").to_numpy(zero_copy_only=False).astype(np.uint64), n)
    value = values.view(np.uint64)
    number, common = lasts < 0, known[value & np.uint64(WORD_COUNTERS - 1)]
    kind = np.where(number, np.uint64(1), np.where(common, mix(value), np.uint64(2))) + tbl * np.uint64(0xD6E8FEB86659FD93)
    place = np.arange(len(value)) - np.repeat(np.cumsum(n) - n, n)

    def back(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        if len(x) > by:
            out[by:] = np.where(place[by:] >= by, x[:-by], np.uint64(0))
        return out

    one = kind
    two = one * _K + back(kind, 1)
    three = two * _K + back(kind, 2)
    contexts = [mix(x + np.uint64(k)) for k, x in enumerate((one, two, three), 11)]
    before = back(kind, 1)
    whole = mix(np.where(number, before * _K + np.uint64(3), tbl + np.uint64(4)))
    part = mix(whole + lasts.view(np.uint64) * _K)
    ends = np.cumsum(n)
    last = np.zeros(len(value), bool)
    last[ends[n > 0] - 1] = True
    return contexts, part, whole, ~common | number, last, ends - 1, n


def _rates(known):
    """Contexts in the first half of the array, ends of texts in the second; words' last letters among the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * COUNTERS, np.uint64)
        mask = np.uint64(COUNTERS - 1)
        for batch in batches:
            contexts, part, whole, rare, last, ends, n = _contexts(batch, known.value)
            free = np.repeat(~batch.column("at_limit").to_numpy(zero_copy_only=False), n)
            for c in contexts:
                np.add.at(out, c[free | ~last] & mask, 1)
                np.add.at(out[COUNTERS:], c[last & free] & mask, 1)
            inside = rare & ~last
            np.add.at(out, part[inside] & mask, 1)
            np.add.at(out, whole[inside] & mask, 1)
        return out

    return run


def _score(known, rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(COUNTERS - 1)
        seen, ended = rates.value[:COUNTERS], rates.value[COUNTERS:]
        for batch in batches:
            contexts, part, whole, rare, _, ends, n = _contexts(batch, known.value)
            rate, share = np.ones(len(n)), np.ones(len(n))
            has = np.flatnonzero(n > 0)
            at = ends[has]
            own_end = ~batch.column("at_limit").to_numpy(zero_copy_only=False)[has]  # whose ends were counted
            text = np.repeat(np.arange(len(has)), n[has])
            r, done = np.ones(len(has)), np.zeros(len(has), bool)
            for c in reversed(contexts):
                i = c[at] & mask
                own = np.bincount(text[(c & mask) == np.repeat(i, n[has])], minlength=len(has)) - ~own_end
                others, other_ends = seen[i].astype(np.int64) - own, ended[i].astype(np.int64) - own_end
                use = ~done & (others * END_RATE >= 1)
                r[use] = (other_ends / np.maximum(others, 1))[use]
                done |= use
            never = (others * LAST_WORD_RATE >= 1) & (other_ends < LAST_WORD_RATE * others)  # the shortest context is the last word
            rate[has] = np.where(never, 0.0, r)
            p = seen[part[at] & mask] / np.maximum(seen[whole[at] & mask], 1)
            share[has] = np.where(rare[at] & (seen[whole[at] & mask] >= LEAST_SEEN), p, 1)
            names = ["tbl", "id", "source", "at_limit"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rate), pa.array(share)], [*names, "end_rate", "last_share"])

    return run


def endings(texts: DataFrame) -> DataFrame:
    """(tbl, id, source, at_limit, end_rate, last_share): how usual the ending of each text is in its table.

    texts: tbl int, id bigint, source string, text string, at_limit boolean. Null texts are left out; texts without tokens count as
    usual.
    """
    spark = texts.sparkSession
    stage = Staging(spark, "endings")
    t = stage.table(_tokens(texts.where(F.col("text").isNotNull())).withColumn("same", F.xxhash64("tokens")), "tokens")
    # A text that is whole in some copy ends there; the ones at a limit aren't judged by their ending.
    different = stage.table(t.groupBy("tbl", "same").agg(F.first("tokens").alias("tokens"), F.first("lasts").alias("lasts"), F.min("at_limit").alias("at_limit")), "different")
    total = different.count()
    counts = gather(different.select("tokens"), _word_counts, WORD_COUNTERS, np.uint64, lambda x: x)
    known = spark.sparkContext.broadcast(counts >= max(KNOWN_LEAST, KNOWN_SHARE * total))
    rates = spark.sparkContext.broadcast(gather(different.select("tbl", "tokens", "lasts", "at_limit"), _rates(known), 2 * COUNTERS, np.uint64, lambda x: x))
    stage.drop("different")
    return t.drop("same").mapInArrow(_score(known, rates), "tbl int, id long, source string, at_limit boolean, end_rate double, last_share double")


def truncated(texts: DataFrame) -> DataFrame:
    """(tbl, id, source, cause): cause is 'limit' for texts at a hidden limit of their source that do not end a sentence there, else 'ending'.

    texts: tbl int, id bigint, source string, text string. Null texts and texts without tokens are whole, and so is a text at the limit
    that ends with a final mark. An empty table gives an empty result.
    """
    texts = texts.select("tbl", "id", "source", "text")
    stage = Staging(texts.sparkSession, "limits")
    found = stage.table(limits(texts).coalesce(1), "limits")
    found = found.groupBy(F.col("tbl").alias("l_tbl"), F.col("source").alias("l_source")).agg(F.collect_list(F.struct("encoding", "limit")).alias("limits"))  # a few of each source
    sized = texts.where(F.col("text").isNotNull()).join(found, (F.col("tbl") == F.col("l_tbl")) & F.col("source").eqNullSafe(F.col("l_source")), "left")

    def reached(x: Column) -> Column:
        size = F.lit(None).cast("long")
        for k, c in lengths(F.col("text")).items():
            size = F.when(x["encoding"] == k, c).otherwise(size)
        return size == x["limit"]

    stopped = F.col("text").rlike(FINAL)
    at = F.coalesce(~stopped & F.exists("limits", reached), F.lit(False))
    scored = endings(sized.select("tbl", "id", "source", "text", at.alias("at_limit")))
    cause = F.when(F.col("at_limit"), "limit").when((F.col("end_rate") < END_RATE) | (F.col("last_share") < LAST_SHARE), "ending")
    return scored.select("tbl", "id", "source", cause.alias("cause")).where("cause is not null")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, subset = spark.read.parquet(f"{sf_dir}/seeds.parquet"), spark.read.parquet(f"{sf_dir}/metadata_subset.parquet")
    one = seeds.select(F.lit(0).alias("tbl"), F.col("record_ordinal").alias("id"), F.col("red_team_model").alias("source"), F.col("prompt_safe").alias("text"))
    return one.unionByName(subset.select(F.lit(1).alias("tbl"), F.col("record_ordinal").alias("id"), F.col("generator_model").alias("source"), F.col("mllm_reasoning").alias("text")))


def _name() -> Column:
    return F.when(F.col("tbl") == 0, "seeds").otherwise("metadata_subset").alias("table_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, record_ordinal of all texts that were cut."""
    return truncated(_texts(spark, sf_dir)).select(_name(), F.col("id").alias("record_ordinal"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates: texts, cut ones by cause, and their share."""
    texts = _texts(spark, sf_dir)
    n = texts.where(F.col("text").isNotNull()).groupBy("tbl", "source").agg(F.count("*").alias("n_texts"))
    cut = truncated(texts).groupBy("tbl", F.col("source").alias("s")).agg(F.count_if(F.col("cause") == "limit").alias("n_limit"), F.count_if(F.col("cause") == "ending").alias("n_ending"))
    x = n.join(cut.withColumnRenamed("tbl", "t"), (F.col("tbl") == F.col("t")) & F.col("source").eqNullSafe(F.col("s")), "left").fillna(0, ["n_limit", "n_ending"])
    return x.select(_name(), "source", "n_texts", "n_limit", "n_ending", F.round((F.col("n_limit") + F.col("n_ending")) / F.col("n_texts"), 6).alias("cut_share"))


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden limits: source, encoding, limit and the texts at it."""
    return limits(_texts(spark, sf_dir)).select(_name(), "source", "encoding", "limit", "at_limit")


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates, "p6_limits": p6_limits}
_LENGTHS = {
    "characters": "c",
    "utf8": "b",
    "utf16": "c + astral",
    "entities": "c + e",
    "entities_utf8": "b + e",
    "json": "c + esc + 5 * beyond + 6 * astral",
    "json_utf8": "b + esc",
    "crlf": "c + crlf",
    "crlf_utf8": "b + crlf",
}
_COUNT = "length(text) - length(regexp_replace(text, '{}', '', 'g'))"
ORACLE = {
    "p6_limits": r"""
WITH t AS (SELECT 'seeds' AS table_name, red_team_model AS source, prompt_safe AS text FROM seeds UNION ALL SELECT 'metadata_subset', generator_model, mllm_reasoning FROM metadata_subset),
l AS (SELECT *, length(text) AS c, strlen(text) AS b, NOT regexp_matches(text, '[.!?。！？…][''"”’»)\]]*\s*$') AS open,"""
    + ", ".join(f" {_COUNT.format(x)} AS {name}" for name, x in {"astral": r"[\x{10000}-\x{10FFFF}]", "beyond": r"[^\x00-\x7F]", "esc1": r"[\"\\\x08\x0C\n\r\t]", "esc5": r"[\x00-\x07\x0B\x0E-\x1F]", "amp": "&", "angle": "[<>]", "quot": '"', "apos": "''"}.items())
    + r""", length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) - length(text) AS crlf FROM t WHERE text IS NOT NULL),
m AS (SELECT *, esc1 + 5 * esc5 AS esc, 4 * amp + 3 * angle + 5 * quot + 4 * apos AS e FROM l),
n AS ("""
    + " UNION ALL ".join(f"SELECT table_name, source, text, open, {k} AS place, '{name}' AS encoding, {x} AS n FROM m" for k, (name, x) in enumerate(_LENGTHS.items()))
    + r"""),
g AS (SELECT table_name, source, place, encoding, n, count(*) AS at_limit, count(DISTINCT text) AS different, count(DISTINCT text) FILTER (open) AS unfinished FROM n GROUP BY ALL),
w AS (SELECT *, coalesce(sum(at_limit) OVER (z RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS below, greatest(coalesce(sum(different) OVER (z RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0), coalesce(sum(different) OVER (z RANGE BETWEEN 1 FOLLOWING AND 10 FOLLOWING), 0)) AS near,
             sum(at_limit) OVER (z RANGE UNBOUNDED PRECEDING) AS upto, sum(at_limit) OVER (PARTITION BY table_name, source, encoding) AS every FROM g WINDOW z AS (PARTITION BY table_name, source, encoding ORDER BY n)),
f AS (SELECT *, at_limit >= 5 AND at_limit * 10 >= 6 * below AND every - upto <= 0.002 * every AND n > 1 AND at_limit < 0.9 * every AS last FROM w
      WHERE (at_limit >= 5 AND at_limit * 10 >= 6 * below AND every - upto <= 0.002 * every AND n > 1 AND at_limit < 0.9 * every) OR (different >= 20 AND different * 10 >= 6 * near AND unfinished >= 0.9 * different AND n > 1)),
p AS (SELECT *, row_number() OVER (PARTITION BY table_name, source, last ORDER BY at_limit DESC, place, n DESC) AS first FROM f),
r AS (SELECT * FROM p WHERE NOT last OR first = 1)
SELECT table_name, source, encoding, n AS "limit", at_limit FROM r WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.table_name = r.table_name AND o.source IS NOT DISTINCT FROM r.source AND abs(o.n - r.n) <= 12
    AND (o.last::INT, o.at_limit, -o.place, o.n) > (r.last::INT, r.at_limit, -r.place, r.n))
""",
}
