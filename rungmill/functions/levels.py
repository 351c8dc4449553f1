"""Severity levels, the category taxonomy and the model registry; their functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungmill.functions.text import letters_digits

#: Levels in rising order (fixed values).
LEVELS = ("safe", "low_risk", "mid_risk", "high_risk")
UNSAFE_LEVELS = LEVELS[1:]
#: Categories (fixed values).
TAXONOMY = (
    "Sexual_Content",
    "Minors",
    "Violence",
    "Self_Harm",
    "Disturbing_Content",
    "Illegal_Activities",
    "Hate_Speech",
    "Misleading_Information",
    "Personal_Identification_Documents",
    "Public_Figures",
    "Intellectual_Property_Violation",
)
#: Scene contexts (fixed values).
SCENE_CONTEXTS = (
    "outdoor setting, natural lighting",
    "indoor setting, warm light",
    "studio photography, clean background",
    "street photography, candid",
    "historical illustration style",
    "digital art, vibrant colors",
    "oil painting style",
    "black and white photograph",
    "cinematic wide shot",
    "close-up portrait",
)
#: Aliases of models (fixed values).
MODELS = {
    "mistral": "mistralai/Mistral-7B-Instruct-v0.1",
    "llama2": "meta-llama/Llama-2-7b-chat-hf",
    "vicuna": "lmsys/vicuna-7b-v1.5",
    "dolphin": "cognitivecomputations/dolphin-2.9-llama3-8b",
}
#: Aliases of image generators (fixed values).
GENERATORS = {
    "sdxl": "stabilityai/stable-diffusion-xl-base-1.0",
    "flux1": "black-forest-labs/FLUX.1-dev",
    "large": "stabilityai/stable-diffusion-3.5-large",
    "zimage": "Tongyi-MAI/Z-Image-Turbo",
}


def norm_level(raw: Column) -> Column:
    """One of the four labels whatever the case and the separators; anything else and null give null."""
    snake = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z]+", "_"), "^_+|_+$", "")
    return F.when(snake.isin(*LEVELS), snake)


def level_rank(level: Column) -> Column:
    """0 for the lowest level; null for none."""
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("long")
    return F.when(at > 0, at - 1)


def norm_category(raw: Column) -> Column:
    """The taxonomy's spelling of a category that agrees with it in letters and digits; else null."""
    bare = letters_digits(raw)
    out = F.lit(None).cast("string")
    for name in TAXONOMY:
        out = F.when(bare == name.replace("_", "").lower(), F.lit(name)).otherwise(out)
    return out


def resolve_model(alias: Column, models: dict[str, str] = MODELS) -> Column:
    """The model's full id; an unknown alias stands for itself, null stays null."""
    known = F.create_map(*[F.lit(x) for pair in models.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(alias, F.lit(""))), alias)


def taxonomy(spark: SparkSession) -> DataFrame:
    """(category, rank): eleven rows."""
    return spark.createDataFrame([(c, k) for k, c in enumerate(TAXONOMY)], "category string, rank int")
