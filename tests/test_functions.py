from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rungmill.functions import identity, levels, names, prompts, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "level"), [("Low_Risk", "low_risk"), ("low risk", "low_risk"), ("LOW-RISK ", "low_risk"), (" safe", "safe"), ("none", None), ("", None), (None, None)])
def test_norm_level(spark, raw, level):
    assert one(spark, levels.norm_level(F.col("a").cast("string")), a=raw) == level


def test_level_rank(spark):
    ranks = [one(spark, levels.level_rank(F.col("a").cast("string")), a=x) for x in (*levels.LEVELS, "other", None)]
    assert ranks == [0, 1, 2, 3, None, None]


def test_norm_category(spark):
    for raw, name in (("self-harm ", "Self_Harm"), ("HATE SPEECH", "Hate_Speech"), ("Weather", None), (None, None)):
        assert one(spark, levels.norm_category(F.col("a").cast("string")), a=raw) == name


def test_resolve_model(spark):
    for alias, model in (("llama2", levels.MODELS["llama2"]), ("own/model", "own/model"), (None, None)):
        assert one(spark, levels.resolve_model(F.col("a").cast("string")), a=alias) == model


def test_prompt_list(spark):
    raw = "\n 1. a first prompt of some length\n2) the second prompt of the list\n   3. an indented one keeps its number\n1. 2. only one number goes here\nfifteen chars..\nsixteen chars ..\n٣. a prompt after an Arabic digit\n"
    got = one(spark, prompts.prompt_list(F.col("a"), 20), a=raw)
    assert got == ["a first prompt of some length", "the second prompt of the list", "3. an indented one keeps its number", "2. only one number goes here", "sixteen chars ..", "a prompt after an Arabic digit"]
    assert one(spark, prompts.prompt_list(F.col("a"), 2), a=raw) == got[:2]
    assert one(spark, prompts.prompt_list(F.col("a"), 0), a=raw) == got[:1]
    assert one(spark, prompts.prompt_list(F.col("a"), 3), a="") == []
    assert one(spark, prompts.prompt_list(F.col("a").cast("string"), 3), a=None) is None


def test_text(spark):
    assert one(spark, text.letters_digits(F.col("a")), a=" É-a_1 ß! ") == "éa1ß"
    assert one(spark, text.words(F.col("a")), a="It's A_b, 3x… ñu") == ["it", "s", "a", "b", "3x", "ñu"]
    assert one(spark, text.words(F.col("a")), a="?!") == []
    assert one(spark, text.strip(F.col("a")), a="　 x  \n") == "x"


def test_identity(spark):
    assert one(spark, identity.ladder_id(F.col("a"), F.col("b")), a="X", b=7) == "X_0007"
    assert one(spark, identity.ladder_id(F.col("a"), F.col("b")), a="X", b=12345) == "X_12345"
    digest = hashlib.md5(b"X_0007|safe").hexdigest()
    assert one(spark, identity.pair_hash(F.col("a"), F.col("b")), a="X_0007", b="safe") == digest
    assert one(spark, identity.image_seed(F.col("a"), F.col("b")), a="X_0007", b="safe") == int(digest[:8], 16)
    assert one(spark, identity.pair_hash(F.col("a").cast("string"), F.col("b")), a=None, b="safe") is None
    assert one(spark, identity.image_path(F.col("a"), F.lit("safe"), F.lit("L"), F.lit("m")), a="C") == "images/C/safe/L_m.png"
    for path, safe in (("a/b.png", "a/b.png"), ("/a.png", None), ("../a.png", None), ("a/../b.png", None), ("a..b/c.png", "a..b/c.png"), ("", None)):
        assert one(spark, identity.safe_relative(F.col("a")), a=path) == safe


def test_scene_context_is_stable(spark):
    x = [one(spark, identity.scene_context(F.col("a"), F.col("b"), F.lit(42)), a="Violence", b=k) for k in (1, 1, 2)]
    assert x[0] == x[1] and set(x) <= set(levels.SCENE_CONTEXTS)


def test_free_names(spark):
    assert names.free(spark.createDataFrame([], "place int, _Place int, a int"), "place", "b") == ["__place", "b"]


@pytest.mark.parametrize(("n", "want"), [(3, 3), (0, 8), (None, 8), (-1, -1)])
def test_or_default(spark, n, want):
    assert one(spark, identity.or_default(F.col("a").cast("int"), F.lit(8)), a=n) == want
