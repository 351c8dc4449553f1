"""Ids, seeds and paths that follow from the data alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungmill.functions.levels import SCENE_CONTEXTS


def pair_hash(a: Column, b: Column) -> Column:
    """MD5 of two values joined by a bar; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.md5(F.concat_ws("|", a, b).cast("binary")))


def image_seed(ladder: Column, level: Column) -> Column:
    """A 32-bit seed of a ladder's rung, the same on every run."""
    return F.conv(F.substring(pair_hash(ladder, level), 1, 8), 16, 10).cast("long")


def ladder_id(category: Column, index: Column) -> Column:
    """CATEGORY_0007; the index has at least four digits and is never cut."""
    return F.format_string("%s_%04d", category, index)


def image_path(category: Column, level: Column, ladder: Column, model: Column) -> Column:
    """images/category/level/ladder_model.png; null if a part is."""
    whole = category.isNotNull() & level.isNotNull() & ladder.isNotNull() & model.isNotNull()
    return F.when(whole, F.concat(F.lit("images/"), category, F.lit("/"), level, F.lit("/"), ladder, F.lit("_"), model, F.lit(".png")))


def scene_context(category: Column, batch: Column, seed: Column) -> Column:
    """One of the scene contexts, by a hash of its arguments instead of a random state."""
    key = F.md5(F.concat_ws("|", category, batch.cast("string"), seed.cast("string")).cast("binary"))
    at = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.lit(len(SCENE_CONTEXTS)))
    return F.element_at(F.array(*[F.lit(x) for x in SCENE_CONTEXTS]), (at + 1).cast("int"))


def or_default(n: Column, default: Column) -> Column:
    """The number, or the default if it is null or zero."""
    return F.coalesce(F.nullif(n, F.lit(0)), default)


def safe_relative(path: Column) -> Column:
    """The path if it is relative and stays below its root; absolute paths and '..' parts give null."""
    bad = path.rlike(r"^(/|\\|[A-Za-z]:)") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return F.when(~bad & (path != ""), path)
