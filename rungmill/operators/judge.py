"""Verdicts: the rules of a record, scorers as columns, and what a verdict removes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungmill.functions.levels import LEVELS, norm_category, norm_level
from rungmill.functions.names import free


def with_rules(records: DataFrame, rules: DataFrame, category: str = "category", level: str = "target_severity") -> DataFrame:
    """Adds rule: that of the record's category and level, read despite spelling; null where there is none; a column rule that the records have is replaced.

    rules: category, level, rule, one for each category and level; of repeated ones the first in alphabetical order counts.
    """
    c, lv = free(records, "c", "lv")
    # Left to Spark's size checks: it sends the rules to every task if they are few.
    r = rules.groupBy(norm_category(F.col("category")).alias(c), norm_level(F.col("level")).alias(lv)).agg(F.min("rule").alias("rule")).where(F.col(c).isNotNull() & F.col(lv).isNotNull())
    return records.drop("rule").join(r, (norm_category(F.col(category)) == F.col(c)) & (norm_level(F.col(level)) == F.col(lv)), "left").drop(c, lv)


def scorer(function: Callable[[pd.Series], pd.Series], load: Callable[[], object] | None = None) -> Callable[[Column], Column]:
    """A column function for a model that scores texts in batches; the model is loaded once in each worker.

    function takes a batch of texts (and the loaded model, if there is one) and returns their scores. Batches are those of
    spark.sql.execution.arrow.maxRecordsPerBatch.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load() if load else None
        for texts in parts:
            yield function(texts, model) if load else function(texts)

    return score


def severity_judge(function: Callable[[pd.Series, pd.Series], pd.DataFrame], tries: int = 3, load: Callable[[], object] | None = None) -> Callable[[Column, Column], Column]:
    """A column function (text, rules) -> struct<level string, verdict string> for a model that judges in batches.

    function takes the texts and the rules that hold for them (and the loaded model, if there is one) and returns a frame with level and verdict.
    A batch that fails is tried again, up to so many times in all; the last failure ends the task, and Spark runs that again elsewhere. How
    many batches run at once is the number of tasks: repartition the records to bound it. The model is loaded once in each worker.
    """

    @F.pandas_udf("level string, verdict string")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        for texts, rules in parts:
            for left in reversed(range(max(1, tries))):
                try:
                    yield (function(texts, rules, model) if load else function(texts, rules))[["level", "verdict"]]
                    break
                except Exception:
                    if not left:
                        raise

    return judged


def word_stub(texts: pd.Series, rules: pd.Series) -> pd.DataFrame:
    """A harmless stand-in for a judge: the level rises with the length of the text; without a rule the verdict is ambiguous."""
    rank = (texts.fillna("").str.len() // 100).clip(upper=3).astype(int)
    return pd.DataFrame({"level": [LEVELS[k] for k in rank], "verdict": rules.notna().map({True: "ok", False: "ambiguous"})})


def lookup(records: DataFrame, key: str, table: DataFrame, table_key: str, value: str, default: str, name: str) -> DataFrame:
    """Adds name: the value that the table has for the record's key, else the default with %s standing for the key.

    table: at most one value for each key, of repeated ones the first in alphabetical order. A null key gets the default with an empty
    text in place of the key.
    """
    k, v = free(records, "k", "v")
    t = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias(k)).agg(F.min(value).alias(v))
    out = records.drop(name) if name != key else records
    filled = F.coalesce(F.col(v), F.format_string(default, F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return out.join(t, F.col(key) == F.col(k), "left").withColumn(name, filled).drop(k, v)


def length_stub(texts: pd.Series) -> pd.Series:
    """A harmless stand-in for a model: longer texts score higher, from 0 to 3."""
    return texts.fillna("").str.len().clip(upper=300) / 100.0


def drop_poisoned(ladders: DataFrame, flagged: DataFrame, ladder: str = "ladder_id") -> DataFrame:
    """Ladders without those whose id is flagged; null ids stay."""
    return ladders.join(flagged.select(F.col(ladder)).where(F.col(ladder).isNotNull()).distinct(), ladder, "left_anti")


def remaining(records: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Records whose key has not been processed yet; keys with nulls are equal to themselves."""
    names = free(records, *keys)
    d = done.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    cond = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return records.join(d, cond, "left_anti")
