"""Abusive, hateful and sexually explicit wording (problem 9).

Multiple-instance learning: reviews label whole documents, but a document is unfit because of a sentence or two. Each sentence has a
score p = sigmoid(w x), a document's score is the noisy-or 1 - product(1 - p) of its sentences, and w is fitted so that document
scores agree with the share of reviewers who flagged it. Scoring then points at the sentences themselves. Sentence scores below FLOOR
are what ordinary wording comes to; they count nothing in a document's score, which therefore doesn't grow with its length.

Features are hashed words, pairs of words and pairs with a gap, of a spelling brought back to plain words: letters spread out by
dots or spaces are joined, digits and signs inside words become the letters they stand for, drawn-out letters are shortened. Texts are
cut at white space, and what each piece comes to is looked up in a table of pieces seen before, so rules run once for each different piece
and all else is done on arrays; only texts with spread letters go through the rules as a whole. The
model is fitted on the driver from at most TRAIN_DOCUMENTS reviewed documents and BACKGROUND_DOCUMENTS others, taken as ordinary; every document is scored, as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_DOCUMENTS = 12_000
BACKGROUND_DOCUMENTS = 5_000  # documents without review that stand for ordinary wording
BACKGROUND_SHARE = 0.3  # weight of all of them against all reviewed ones: a few of them are unfit as well
MOST_BACKGROUND = 0.2  # weight of one of them at most
LEAST_DOCUMENTS = 2  # features of fewer training documents would only let the model learn single reviews by heart
TRAIN_CHARS = 20_000  # longer documents don't train the model
SLOTS = 1 << 18
ROUNDS = 200
RATE = 0.08
DECAY = 1.0
BIAS = -5.0
THRESHOLD = 0.4
FLOOR = 0.1
PIECES, PIECE_CHARS = 300_000, 40  # pieces of text that a worker keeps, and the longest kept
CHARS_AT_ONCE = 1_000_000

#: Signs that stand for letters inside words (fixed values).
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
_SPREAD = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*] ?[^\W\d_]){2,}(?![^\W_])|(?<![^\W_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W_])")
_MIXED = re.compile(r"(?=[\w@$!*]*[^\W\d_])[\w@$!*]*[\d@$!][\w@$!*]*[^\W\d_][\w@$!*]*|[^\W\d_]+[@$!\d]+[^\W\d_]+")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"(?<=[.!?。！？…])[\s\"'”»)]+|\s*[\r\n]+\s*|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+(?:\*+[^\W_]*)*|\*+[^\W_]+")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


def plain(text: str) -> str:
    """Lower case, with letters that were spread, swapped or drawn out brought back."""
    text = text.lower()
    text = _SPREAD.sub(lambda m: re.sub(r"[.\-_* ]", "", m[0]), text)
    text = _MIXED.sub(lambda m: m[0].translate(LOOKALIKES), text)
    return _DRAWN.sub(r"\1", text)


def sentences(text: str) -> list[str]:
    """Sentences and lines that hold a letter or digit."""
    return [s for s in _END.split(text) if s and _WORD.search(s)]


def _words(sentence: str) -> list[str]:
    found = _WORD.findall(sentence)
    if _CJK.search(sentence):  # written without spaces: single characters are the words
        return [c for w in found for c in (w if _CJK.search(w) else [w])]
    return found


_ALONE = re.compile(r"[.\-_*]*[^\W\d_][.\-_*]*")


class _Pieces(dict):
    """The number of each piece of text seen; what it comes to stands in arrays: hashes of its words, with 0 where a sentence ends."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes, self.starts, self.alone = array("Q", [0]), array("q", [0, 1]), array("b", [0])
        self["\0"] = 0  # stands for the end of a line

    def __missing__(self, piece: str) -> int:
        for k, part in enumerate(_END.split(piece + " ")):
            if k:
                self.hashes.append(0)
            self.hashes.extend(map(_hash, _words(plain(part))))
        self.starts.append(len(self.hashes))
        self.alone.append(_ALONE.fullmatch(piece) is not None)
        number = len(self.alone) - 1
        if len(piece) <= PIECE_CHARS:
            self[piece] = number
        return number


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1


class Vectors:
    """Hashed features of the sentences of texts."""

    def __init__(self, most: int = PIECES):
        self.pieces, self.most = _Pieces(), most

    def _hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of words, 0 where a sentence ends; text of each)."""
        if len(self.pieces.alone) > self.most:
            self.pieces.reset()
        cut = [t.lower().replace("\0", "\x01").replace("\n", " \0 ").replace("\r", " \0 ").split() for t in texts]
        number = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        text = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        hashes, starts, alone = np.array(self.pieces.hashes, np.uint64), np.array(self.pieces.starts, np.int64), np.array(self.pieces.alone, bool)[number]
        begin, n = starts[number], starts[number + 1] - starts[number]
        # Three pieces in a row that hold a single letter each may be a word spread out.
        three = alone[2:] & alone[1:-1] & alone[:-2] & (text[2:] == text[:-2])
        odd = np.unique(text[2:][three])
        if len(odd):
            n = np.where(np.isin(text, odd), 0, n)
        out = hashes[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        at = np.repeat(text, n)
        for k in odd:
            more = [h for s in sentences(texts[k]) for h in (*map(_hash, _words(plain(s))), 0)]
            out, at = np.append(out, np.array(more, np.uint64)), np.append(at, np.full(len(more), k))
        if len(odd):
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
        return out, at

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slots, sentence of each, text of each sentence); sentences are numbered through all texts, those without words left out."""
        flat, text = self._hashes(texts)
        end = flat == 0
        sentence = np.cumsum(np.concatenate([[0], (end[:-1] | (text[1:] != text[:-1])).astype(np.int64)])) if len(flat) else np.zeros(0, np.int64)
        flat, text, sentence = flat[~end], text[~end], sentence[~end]
        new = np.concatenate([[True], sentence[1:] != sentence[:-1]]) if len(flat) else np.zeros(0, bool)
        row = np.cumsum(new) - 1
        slots, rows = [self._slot(flat)], [row]
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            if len(flat) > gap:
                ok = row[gap:] == row[:-gap]
                slots.append(self._slot((flat[:-gap] * np.uint64(salt) + flat[gap:])[ok]))
                rows.append(row[gap:][ok])
        return np.concatenate(slots), np.concatenate(rows), text[new]

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(32))
        return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def fit(texts: list[str], targets: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the slots and, last, the bias; targets: the share of flags of each document, which counts with its weight."""
    slots, rows, doc = Vectors()(texts)
    pair = np.unique(rows * SLOTS + slots)
    rows, slots = pair // SLOTS, pair % SLOTS
    often = np.bincount(np.unique(doc[rows] * SLOTS + slots) % SLOTS, minlength=SLOTS) >= LEAST_DOCUMENTS
    rows, slots = rows[often[slots]], slots[often[slots]]
    scale = (weight / max(weight.sum(), 1e-9))[doc]
    used, slots = np.unique(slots, return_inverse=True)
    by_slot = np.argsort(slots, kind="stable")
    row_starts, slot_starts, rows_by_slot = np.flatnonzero(np.diff(rows, prepend=-1)), np.flatnonzero(np.diff(slots[by_slot], prepend=-1)), rows[by_slot]
    w, b = np.zeros(len(used)), BIAS
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for k in range(1, rounds + 1):
        z = np.full(len(doc), b)
        if len(rows):
            z[rows[row_starts]] += np.add.reduceat(w[slots], row_starts)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_not = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(texts))
        whole = np.clip(1 - np.exp(log_not), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence, where loss is the cross entropy of noisy-or and target
        g = p * (1 - targets[doc] / whole[doc]) * scale
        gw = (np.add.reduceat(g[rows_by_slot], slot_starts) if len(rows) else w) + DECAY * w / max(weight.sum(), 1e-9)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c, d = 1 - 0.9**k, 1 - 0.999**k
        w -= RATE * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= RATE * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    out = np.zeros(SLOTS + 1, np.float32)
    out[used], out[-1] = w, b
    return out


def score_texts(texts: list[str], weights: np.ndarray, vectors: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """(score of each sentence, text of each sentence)."""
    slots, rows, text = vectors(texts)
    used = weights[slots] != 0
    pair = np.unique(rows[used] * SLOTS + slots[used])  # a feature counts once in a sentence
    z = np.bincount(pair // SLOTS, weights[pair % SLOTS], minlength=len(text)) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), text


def noisy_or(scores: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Scores of n texts from those of their sentences; what a sentence has above FLOOR counts."""
    p = np.maximum(scores - FLOOR, 0) / (1 - FLOOR)
    return 1 - np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def training_sample(documents: DataFrame, reviews: DataFrame, most: int = TRAIN_DOCUMENTS, background: int = BACKGROUND_DOCUMENTS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, shares of flags, weights) of at most ``most`` reviewed documents and ``background`` others; each reviewer counts once, null flags don't."""
    votes = reviews.where(F.col("flagged").isNotNull()).groupBy("doc_id", "reviewer").agg(F.avg("flagged").alias("flag"))
    votes = votes.groupBy("doc_id").agg(F.avg("flag").alias("share"))
    d = documents.where(F.col("text").isNotNull() & (F.char_length("text") <= TRAIN_CHARS)).select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
    seen = d.join(votes, "doc_id").orderBy("key", "doc_id").limit(most).select("text", "share").collect()
    other = d.join(votes.select("doc_id"), "doc_id", "left_anti").orderBy("key", "doc_id").limit(background).select("text").collect()
    texts = [r["text"] for r in seen] + [r["text"] for r in other]
    return texts, np.array([r["share"] for r in seen] + [0.0] * len(other), np.float64), np.array([1.0] * len(seen) + [min(MOST_BACKGROUND, BACKGROUND_SHARE * len(seen) / max(1, len(other)))] * len(other), np.float64)


_SCORED = "doc_id long, source string, score double, worst_sentence string, worst_score double, n_sentences long"


def scored_documents(documents: DataFrame, reviews: DataFrame, with_sentence: bool = True, most: int = TRAIN_DOCUMENTS, background: int = BACKGROUND_DOCUMENTS) -> DataFrame:
    """(doc_id, source, score, worst_sentence, worst_score, n_sentences) of every document.

    documents: doc_id bigint, text, source; reviews: doc_id, reviewer, flagged. Null and empty texts score 0 and have no worst sentence.
    Without any reviewed document all scores are those of the untrained bias. worst_sentence is null unless asked for. The model is fitted to
    at most ``most`` reviewed documents and ``background`` others.
    """
    spark = documents.sparkSession
    weights = spark.sparkContext.broadcast(fit(*training_sample(documents, reviews, most, background)))

    def part(ids, sources, texts: list[str], vectors: Vectors) -> pa.RecordBatch:
        p, text = score_texts(texts, weights.value, vectors)
        n = np.bincount(text, minlength=len(texts))
        first = np.cumsum(n) - n
        order = np.lexsort((np.arange(len(p)), -p, text))  # the first of the worst stands first
        worst, score = np.zeros(len(texts)), noisy_or(p, text, len(texts))
        some = n > 0
        worst[some] = p[order[first[some]]]
        said = [None] * len(texts)
        if with_sentence:
            for k in np.flatnonzero(some):
                found = sentences(texts[k])
                said[k] = found[min(int(order[first[k]] - first[k]), len(found) - 1)] if found else None
        return pa.RecordBatch.from_arrays([ids, sources, pa.array(score), pa.array(said, pa.string()), pa.array(worst), pa.array(n, pa.int64())], ["doc_id", "source", "score", "worst_sentence", "worst_score", "n_sentences"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            group = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE
            for at in np.flatnonzero(np.diff(group, prepend=-1)):
                upto = int(np.searchsorted(group, group[at], "right"))
                yield part(batch.column("doc_id").slice(at, upto - at), batch.column("source").slice(at, upto - at), texts[at:upto], vectors)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, _SCORED)


def _scored(spark: SparkSession, sf_dir: str, with_sentence: bool = False) -> DataFrame:
    return scored_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/doc_reviews.parquet"), with_sentence)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of documents with abusive, hateful or sexual wording: a score of at least THRESHOLD."""
    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document and its worst sentence."""
    return _scored(spark, sf_dir, True).select("doc_id", F.round("score", 6).alias("score"), "worst_sentence", F.round("worst_score", 6).alias("worst_score"), "n_sentences")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and unfit documents (as in p9_found) of each source."""
    x = _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("score") >= THRESHOLD).alias("n_unfit"))
    return x.withColumn("unfit_share", F.round(F.col("n_unfit") / F.col("n_documents"), 6))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLE: dict[str, str] = {}
