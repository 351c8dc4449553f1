"""Prompt and response pairs with a defective response (problem 3).

Each response has at most one defect, tested in this order: empty (nothing but a placeholder), copy (gives the prompt back), refusal
(declines), other_language (the language posteriors of prompt and response, from a naive Bayes model of character n-grams, differ
clearly), truncated (the end-of-text likelihood of the last characters is low: texts of this table hardly ever end so).

The language model is trained on a bounded sample of labelled documents (TRAIN_TEXTS whole texts of each language); end rates are
counted over all different responses, without the one that is judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.levels import LEVELS
from rungmill.llm.languages import LanguageModel, labelled_sample, train
from rungmill.llm.sketches import gather

TRAIN_TEXTS = 300
MARGIN_PER_TEXT, MARGIN_PER_LETTER = 4.0, 0.06  # by how much a response's language must beat the prompt's, in nats
PROMPT_MARGIN = 1.0  # nats by which a prompt's language is known
COPY_OF_PROMPT, ADDED_SHARE, LEAD_IN = 0.6, 0.2, 5  # of the distinct words: share of the prompt given back; what the response may add, as a share or as the words of a lead-in
END_COUNTERS = 1 << 20
END_ORDERS = (1, 2, 3)
END_RATE = 0.004

#: Placeholders in letters and digits alone (fixed values).
PLACEHOLDERS = frozenset("tbd todo tba tbc none null nil nan na noexplanation noexplanationavailable noanswer noresponse notavailable notapplicable pending placeholder missing empty blank unknown undefined explanation xxx lorem loremipsum".split())
#: Ways to decline (fixed values): someone who speaks of themselves or of the request, and cannot or will not answer.
REFUSALS = [
    r"\bi(?:'m| am) (?:so |very |truly )?sorry\b.{0,40}\b(?:can't|cannot|can not|unable|not able|won't|but)\b",
    r"\bi (?:can't|cannot|can not|could not|won't|will not|must decline|have to decline|decline|refuse|do not feel comfortable|don't feel comfortable|am not able|am unable|am not allowed|am not permitted)\b",
    r"\bi'm (?:not able|unable|not allowed|not permitted|not comfortable|afraid i)\b",
    r"\b(?:sorry|apologies|apologize|unfortunately)\b.{0,60}\b(?:unable|not able|not something i|against my|guidelines|policy|policies|can't|cannot)\b",
    r"\b(?:against|violates?|violating) (?:my|the|our) (?:\w+ )?(?:guidelines|polic(?:y|ies)|rules)\b",
    r"\b(?:request|content|prompt|question) (?:can't|cannot|can not) be (?:fulfilled|answered|processed|explained|completed)\b",
    r"\boutside (?:of )?what i(?:'m| am) (?:allowed|able|permitted)\b",
    r"\bno (?:explanation|answer|description|response) can be (?:given|provided)\b",
    r"\b(?:ich|wir) (?:darf|dürfen|kann|können|werde|werden|möchte)\b.{0,80}\b(?:keine?n?|nicht)\b",
    r"\b(?:tut mir leid|leider (?:kann|darf)|es ist mir nicht (?:möglich|erlaubt))\b",
    r"\b(?:je (?:ne )?(?:peux|puis|suis|veux|dois|refuse)\b.{0,60}(?:\bpas\b|\brefuser\b|\bdécliner\b|désolée?)|je (?:regrette|refuse)|désolée?[ ,])",
    r"\b(?:leider|malheureusement|lamentablemente|desafortunadamente|purtroppo|infelizmente|helaas|niestety)\b.{0,60}\b(?:nicht|kein\w*|pas|no|non|não|niet|nie)\b|\bich leider nicht\b",
    r"\bil m'est (?:impossible|interdit)\b",
    r"\b(?:lo siento|no puedo|no debo|no me es posible|no estoy autorizad[oa]|me niego|debo rechazar|no se me permite|lamento)\b",
    r"\b(?:non posso|mi dispiace|não posso|desculpe|nie mogę|przykro mi|ik kan (?:dit|deze|daar|hier)\b.{0,40}\bniet|не могу|к сожалению)\b",
    r"(?:申し訳|できません。?$|お答えできません|抱歉|我不能|无法)",
]

_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“]*“|(?<!\w)'[^']*'(?!\w)")
_REFUSAL = re.compile("|".join(REFUSALS), re.IGNORECASE | re.DOTALL)


def is_empty(text: str | None) -> bool:
    """Null, blank, without letters and digits, or a placeholder."""
    if text is None:
        return True
    bare = "".join(_WORD.findall(text.lower()))
    return not bare or bare in PLACEHOLDERS


def is_copy(prompt: str, response: str) -> bool:
    """Whether the response has hardly a word that the prompt lacks, and most of the prompt's; a lead-in is allowed."""
    p = set(_WORD.findall(prompt.lower()))
    for r in (set(_WORD.findall(response.lower())), set(_WORD.findall(response.partition(":")[2].lower()))):
        if p and r and (len(r - p) <= ADDED_SHARE * len(r) and len(p & r) >= COPY_OF_PROMPT * len(p) or len(r - p) <= LEAD_IN and len(p & r) >= 0.8 * len(p)):
            return True
    return False


def is_refusal(response: str) -> bool:
    """Whether someone declines to answer, outside of anything quoted."""
    return bool(_REFUSAL.search(_QUOTED.sub(" ", response).replace("’", "'")))


def _tails(texts: list[str]) -> np.ndarray:
    """The last three characters of each text, without white space after them, as numbers."""
    out = np.zeros((len(texts), 3), np.uint64)
    for k, t in enumerate(texts):
        tail = t.rstrip()[-3:].lower()
        for j, c in enumerate(reversed(tail)):
            out[k, j] = ord(c)
    return out


def _slot(*chars: np.ndarray) -> np.ndarray:
    x = np.zeros_like(chars[0]) + np.uint64(len(chars))
    for c in chars:
        x = x * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)


def _points(texts: list[str]) -> np.ndarray:
    """The characters of texts as numbers, two zeros before each text."""
    return np.frombuffer("\0\0".join(["", *texts]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _runs(points: np.ndarray, order: int) -> np.ndarray:
    """The slot of the run of so many characters that ends at each point from number order - 1 on."""
    return _slot(*[points[order - 1 - j : len(points) - j] for j in range(order)])


def _end_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How often each run of one to three characters stands anywhere, and, in the second half, at an end."""
    out = np.zeros(2 * END_COUNTERS, np.uint64)
    for batch in batches:
        texts = [t.rstrip().lower() for t in batch.column("response").to_pylist() if t is not None]
        points = _points(texts)
        for order in END_ORDERS:
            if len(points) >= order:
                out[:END_COUNTERS] += np.bincount(_runs(points, order).astype(np.int64), minlength=END_COUNTERS).astype(np.uint64)
        tails = _tails(texts)
        for order in END_ORDERS:
            np.add.at(out[END_COUNTERS:], _slot(*[tails[:, j] for j in range(order)]), 1)
    return out


def end_rates(texts: list[str], counts: np.ndarray) -> np.ndarray:
    """The rate at which other texts end where they hold the last characters of these; the longest run of them that others hold 30 times counts."""
    seen, ended = counts[:END_COUNTERS].astype(np.int64), counts[END_COUNTERS:].astype(np.int64)
    texts = [t.rstrip().lower() for t in texts]
    tails, points = _tails(texts), _points(texts)
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    rate, done = np.ones(len(texts)), np.zeros(len(texts), bool)
    for order in reversed(END_ORDERS):
        at = _slot(*[tails[:, j] for j in range(order)])
        its = text[order - 1 :]
        own = np.bincount(its[_runs(points, order) == at[its]], minlength=len(texts)) if len(its) else 0
        others = seen[at] - own
        use = ~done & (others >= 30)
        rate[use] = ((ended[at] - 1) / np.maximum(others, 1))[use]
        done |= use
    return rate


def other_language(model: LanguageModel, prompts: list[str], responses: list[str]) -> np.ndarray:
    """Whether the best language of each response differs from its prompt's and beats it by the margin."""
    if not prompts or len(model.languages) < 2:
        return np.zeros(len(prompts), bool)
    (p, _), (r, letters) = model.scores(prompts), model.scores(responses)
    mine, best = p.argmax(axis=1), r.argmax(axis=1)
    row = np.arange(len(prompts))
    sure = p[row, mine] - p[row, best] >= PROMPT_MARGIN
    return (mine != best) & sure & (r[row, best] - r[row, mine] >= MARGIN_PER_TEXT + MARGIN_PER_LETTER * letters)


def _flag(model, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts, responses = batch.column("prompt").to_pylist(), batch.column("response").to_pylist()
            defect: list[str | None] = [None] * len(prompts)
            open_ = []
            for k, (p, r) in enumerate(zip(prompts, responses, strict=True)):
                if is_empty(r):
                    defect[k] = "empty"
                elif is_copy(p, r):
                    defect[k] = "copy"
                elif is_refusal(r):
                    defect[k] = "refusal"
                else:
                    open_.append(k)
            texts = [responses[k] for k in open_]
            foreign = other_language(LanguageModel(*model.value), [prompts[k] for k in open_], texts)
            rates = end_rates(texts, counts.value)
            for k, f, rate in zip(open_, foreign, rates, strict=True):
                defect[k] = "other_language" if f else "truncated" if rate < END_RATE else None
            names = [n for n in batch.schema.names if n not in ("prompt", "response")]
            out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(defect, pa.string())], [*names, "defect"])
            yield out.filter(out.column("defect").is_valid())

    return run


def defective_pairs(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, part, defect): pairs whose response is empty, a copy, a refusal, in another language or truncated.

    pairs: id bigint, part string, prompt string, response string; documents: doc_id, text, lang, from which languages are learned.
    Pairs with a null prompt are left out; an empty prompt can have no copy, and its response no other language. Without labelled
    documents nothing is found to be in another language. Whole texts are read, however long.
    """
    spark = pairs.sparkSession
    samples = labelled_sample(documents, TRAIN_TEXTS)
    learned = train(samples)
    model = spark.sparkContext.broadcast((learned.languages, learned.tables))
    given = pairs.where(F.col("prompt").isNotNull())
    different = given.select(F.lower(F.regexp_replace("response", r"(?U)\s+$", "")).alias("response")).distinct()
    counts = spark.sparkContext.broadcast(gather(different, _end_counts, 2 * END_COUNTERS, np.uint64, lambda x: x))
    return given.select("id", "part", "prompt", "response").mapInArrow(_flag(model, counts), "id long, part string, defect string")


def rung_pairs(subset: DataFrame) -> DataFrame:
    """One row for each rung that exists: id, part (the rung), prompt, response (the explanation), model."""
    rungs = F.array(*[F.struct(F.lit(x).alias("part"), F.col(f"rung_{x}.prompt").alias("prompt"), F.col(f"rung_{x}.explanation").alias("response")) for x in LEVELS])
    return subset.select(F.col("record_ordinal").alias("id"), "generator_model", F.inline(F.filter(rungs, lambda x: x["prompt"].isNotNull())))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_ordinal, rung, defect over all rungs of metadata_subset."""
    pairs = rung_pairs(spark.read.parquet(f"{sf_dir}/metadata_subset.parquet"))
    found = defective_pairs(pairs, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("record_ordinal"), F.col("part").alias("rung"), "defect")


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by kind and rung."""
    return p3_found(spark, sf_dir).groupBy("rung", "defect").agg(F.count("*").alias("n_pairs"))


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates}
ORACLE: dict[str, str] = {}
