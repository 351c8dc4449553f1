"""Language posteriors from character n-grams (naive Bayes)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after the other, length of each); each text in lower case between two spaces."""
    parts = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.array([len(p) for p in parts], np.int64)


def ngram_buckets(points: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that ends at each code point; at the start of a text it is shorter. Digits and marks count as spaces."""
    x = points.astype(np.uint64)
    value, out = x, x * np.uint64(0x9E3779B1) + np.uint64(order)
    for j in range(1, order):
        back = np.zeros_like(value)
        back[j:] = value[:-j] if j < len(value) else 0
        back[(np.arange(len(x)) - starts) < j] = 0
        out = out * np.uint64(0x85EBCA6B) + back + np.uint64(j)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(40)).astype(np.int64) % BUCKETS


def _letters(points: np.ndarray) -> np.ndarray:
    """ASCII digits and marks, and general punctuation, as spaces, so that they tell nothing."""
    ascii_mark = (points < 65) | ((points > 90) & (points < 97)) | ((points > 122) & (points < 128))
    return np.where(ascii_mark | ((points >= 0x2000) & (points < 0x2070)) | ((points >= 0xA0) & (points < 0xC0)), np.uint32(32), points)


@dataclass
class LanguageModel:
    """log P(n-gram | language) for each bucket and order; languages with no training text are unknown to it."""

    languages: list[str]
    tables: list[np.ndarray]

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text in each language under equal priors, number of letters)."""
        points, n = code_points(texts)
        points = _letters(points)
        starts = np.repeat(np.cumsum(n) - n, n)
        total = np.zeros((len(texts), len(self.languages)), np.float64)
        first = np.cumsum(n) - n
        for order, table in zip(ORDERS, self.tables, strict=True):
            total += np.add.reduceat(table[ngram_buckets(points, starts, order)], first, axis=0)
        letters = np.add.reduceat((points != 32).astype(np.int64), first) if len(n) else np.zeros(0, np.int64)
        # Orders overlap, so each counts for its share.
        return total / len(ORDERS), letters


def train(samples: list[tuple[str, str]]) -> LanguageModel:
    """samples: (language, text)."""
    names = sorted({lang for lang, _ in samples})
    counts = [np.full((BUCKETS, len(names)), SMOOTHING, np.float64) for _ in ORDERS]
    for k, name in enumerate(names):
        points, n = code_points([t for lang, t in samples if lang == name])
        points = _letters(points)
        starts = np.repeat(np.cumsum(n) - n, n)
        for order, table in zip(ORDERS, counts, strict=True):
            np.add.at(table[:, k], ngram_buckets(points, starts, order), 1)
    return LanguageModel(names, [np.log(c / c.sum(axis=0)).astype(np.float32) for c in counts])


def labelled_sample(documents: DataFrame, per_language: int, most_chars: int = 400_000) -> list[tuple[str, str]]:
    """A bounded sample of texts with a language code: of each code's first two letters up to per_language texts, chosen by hash.

    At most per_language x 20,000 characters of a language reach the driver, one row at a time, and whole texts of at most most_chars
    characters are kept; texts of more than 20,000 characters are left to others of their language.
    """
    code = F.lower(F.substring("lang", 1, 2))
    d = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") >= 40) & (F.char_length("text") <= 20_000) & F.lower("lang").rlike("^[a-z]{2}(-|$)"))
    d = d.select(code.alias("lang"), "text", F.xxhash64("doc_id").alias("key"))
    # Spark limits each language to its least hashes before the shuffle and again after it.
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= per_language)
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("lang", "rank").toLocalIterator():
        kept = out.setdefault(r["lang"], [])
        if sum(map(len, kept)) + len(r["text"]) <= most_chars:
            kept.append(r["text"])
    return [(lang, t) for lang, texts in out.items() for t in texts]
