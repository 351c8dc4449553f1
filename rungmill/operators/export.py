"""The public projection of ladders: kept columns alone, in a fixed and in an open schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungmill.functions.levels import LEVELS

#: Kept columns of a ladder and of a rung (fixed values).
KEPT = ("ladder_id", "category", "generator_model", "red_team_model", "seed")
KEPT_RUNG = ("prompt", "image_path", "explanation")


def public(ladders: DataFrame) -> DataFrame:
    """Kept columns, and of each rung the kept fields; a rung that is null becomes a struct of nulls."""
    rungs = [F.struct(*[F.col(f"rung_{x}.{k}").alias(k) for k in KEPT_RUNG]).alias(f"rung_{x}") for x in LEVELS]
    return ladders.select(*KEPT, *rungs)


def public_open(records: DataFrame, column: str = "record") -> DataFrame:
    """The same for variants of any shape: (record map<string,variant>).

    Absent top-level keys stay absent. A rung keeps prompt and image_path only if it has them and always has explanation; a rung that is
    missing or no object becomes {"explanation": null}.
    """
    top = F.from_json(F.to_json(column), "map<string,variant>")
    kept = F.map_filter(top, lambda k, v: k.isin(*KEPT))
    none = F.parse_json(F.lit('{"explanation":null}'))

    def rung(x: str) -> Column:
        v = F.try_element_at(top, F.lit(f"rung_{x}"))
        fields = F.map_filter(F.from_json(F.to_json(v), "map<string,variant>"), lambda k, _: k.isin(*KEPT_RUNG))
        null = F.create_map(F.lit("explanation"), F.parse_json(F.lit("null")))
        whole = F.when(F.map_contains_key(fields, "explanation"), fields).otherwise(F.map_concat(fields, null))
        return F.when(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"), F.try_parse_json(F.to_json(whole, {"ignoreNullFields": "false"}))).otherwise(none)

    rungs = F.create_map(*[y for x in LEVELS for y in (F.lit(f"rung_{x}"), rung(x))])
    return records.select(F.map_concat(kept, rungs).alias("record"))


def removed_columns(df: DataFrame) -> list[str]:
    """Columns that the export leaves out, in order."""
    return sorted(set(df.columns) - set(KEPT) - {f"rung_{x}" for x in LEVELS})


def removed_rung_fields(df: DataFrame) -> list[str]:
    """Rung fields that the export leaves out, over all rungs, in order."""
    fields = {f.name for x in LEVELS if f"rung_{x}" in df.columns for f in getattr(df.schema[f"rung_{x}"].dataType, "fields", [])}
    return sorted(fields - set(KEPT_RUNG))
