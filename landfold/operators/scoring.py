"""Classification, triage scores, messages and deep key search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import col

# Entity categories, connector subtypes and source kinds.
CATEGORIES = ("building", "outdoor_area", "path", "zone", "floor", "space", "elevator", "stairs", "escalator",
              "entrance", "connector", "facility", "other")
CONNECTOR_SUBTYPES = {"elevator": "elevator", "lift": "elevator", "stairs": "stairs", "escalator": "escalator",
                      "entrance": "entrance", "exit": "entrance", "door": "entrance"}
SOURCE_KINDS = {"Lift Shaft": "elevator", "Staircase": "stairs", "Escalator": "escalator"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def classify(type, subtype, source_types) -> Column:
    """Category of an entity; a connector without subtype takes its single distinct source kind."""
    kinds = F.array_distinct(F.array_compact(F.transform(col(source_types), lambda s: F.try_element_at(_map(SOURCE_KINDS), s))))
    connector = F.coalesce(
        F.try_element_at(_map(CONNECTOR_SUBTYPES), col(subtype)),
        F.when(col(subtype).isNull() & (F.size(kinds) == 1), kinds[0]), F.lit("connector"),
    )
    return F.when(col(type) == "connector", connector).when(col(type).isin(*CATEGORIES), col(type)).otherwise("other")


def triage(df: DataFrame, flat_gain: float = 1.1) -> DataFrame:
    """Additive score with its reasons, and the level it reaches. A NULL ratio gives no reason."""
    rules = [
        (F.col("current_form"), 5, "current-form"), (F.col("current_form") & F.col("needs_review"), 2, "runtime-review"),
        (F.col("focus"), 3, "focus"), (F.col("missing_owners") > 0, 2, "missing-owners"),
        (F.col("texture_ratio") < flat_gain, 2, "texture-gain"), (F.col("triangle_ratio") < flat_gain, 1, "geometry-gain"),
    ]
    score = sum((F.when(test, points).otherwise(0) for test, points, _ in rules), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in rules]))
    out = df.withColumns({"score": score, "reasons": reasons})
    level = F.when(F.col("score") >= 8, "P0").when(F.col("score") >= 5, "P1").when(F.col("score") >= 3, "P2").otherwise("P3")
    return out.withColumn("level", level)


def translate_messages(asked: DataFrame, book: dict[tuple[str, str], str], fallback: tuple[str, ...] = ("zh-Hans",)) -> DataFrame:
    """Message per row: its locale, then the fallbacks, then the key itself; {params} filled in."""
    from landfold.functions.text import fill_message

    table = _map({f"{loc}/{key}": msg for (loc, key), msg in book.items()})
    found = F.coalesce(*[F.try_element_at(table, F.concat_ws("/", loc, F.col("key"))) for loc in (F.col("locale"), *map(F.lit, fallback))], F.col("key"))
    return asked.withColumn("template", found).withColumn("message", fill_message("template", "params")).drop("template")


def bound_ids(document: Column, keys: list[str]) -> Column:
    """Every id that an object at any depth of the JSON text binds under one of the keys."""
    pattern = '"(?:' + "|".join(keys) + r')"\s*:\s*"([^"]*)"'
    return F.regexp_extract_all(document, F.lit(pattern), 1)


def binds_key(document: Column, ident: Column, keys: list[str]) -> Column:
    """Does any object at any depth of the JSON text bind the id under one of the keys?"""
    return F.array_contains(bound_ids(document, keys), ident)


def public_rows(df: DataFrame, private: list[str]) -> DataFrame:
    return df.where("visible").drop(*private)
