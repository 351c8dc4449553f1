"""Monotonic ladders: scores must rise from level to level by a least gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungmill.functions.levels import LEVELS
from rungmill.functions.names import free

LEAST_GAP = 0.4


def _scores(prefix: str) -> list[Column]:
    return [F.nanvl(F.col(f"{prefix}{x}").cast("double"), F.lit(None).cast("double")) for x in LEVELS]


def _broken(least_gap: float, prefix: str) -> tuple[Column, Column]:
    """(pairs that break the rise, whether the ladder is valid)."""
    scores = _scores(prefix)
    steps = list(zip(LEVELS, scores, strict=True))
    pairs = [F.when(F.round(hi - lo, 6) < least_gap, F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"))) for (a, lo), (b, hi) in zip(steps, steps[1:], strict=False)]
    broken = F.array_compact(F.array(*pairs))
    return broken, ~_partial(prefix) & (F.size(broken) == 0)


def _partial(prefix: str) -> Column:
    return F.exists(F.array(*_scores(prefix)), lambda s: s.isNull())


def monotonic(ladders: DataFrame, least_gap: float = LEAST_GAP, prefix: str = "mllm_score_") -> DataFrame:
    """Adds valid, partial and broken (an array of structs lo, hi): adjacent levels whose scores rise by less than the gap.

    Gaps are rounded to six digits, so 1.0 to 1.4 is a gap of 0.4. A null or NaN score makes the ladder partial and invalid, and its pairs
    are not counted as broken.
    """
    broken, valid = _broken(least_gap, prefix)
    return ladders.withColumns({"broken": broken, "partial": _partial(prefix), "valid": valid})


def keep_valid(ladders: DataFrame, least_gap: float = LEAST_GAP, prefix: str = "mllm_score_") -> DataFrame:
    """The ladders whose every rung has a score and whose scores rise by the gap; their own columns alone."""
    (valid,) = free(ladders, "ok")
    _, ok = _broken(least_gap, prefix)
    return ladders.withColumn(valid, ok).where(valid).drop(valid)


def mismatched_levels(ladders: DataFrame, prefix: str = "mllm_score_") -> DataFrame:
    """Adds mismatched: the levels, in rising order, whose score rounds (halves up) to the rank of another level.

    Scores run from 0 to 3, one rank for each level. A null or NaN score tells nothing and is no mismatch; a score out of range is one.
    """
    wrong = [F.when(F.floor(s + 0.5) != k, F.lit(x)) for k, (x, s) in enumerate(zip(LEVELS, _scores(prefix), strict=True))]
    return ladders.withColumn("mismatched", F.array_compact(F.array(*wrong)))
