"""Flow fields straight from document texts, where an absent key and an explicit null differ.

A typed read gives null for both. Here the text becomes a VARIANT, which keeps
the difference: a path that is absent reads as SQL null, a null as a variant null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_texts(df: DataFrame, value: str = "value") -> DataFrame:
    """One row per ``results[]`` element of the JSON texts in ``value``: ``pos`` and ``result`` (variant).

    A text that is no JSON raises. Texts that are null, or have no results or
    another value than an array there, give no rows. Other columns pass.
    """
    doc = F.parse_json(F.col(value))
    rows = df.select(*[c for c in df.columns if c not in (value, "pos", "result")],
                     F.posexplode_outer(F.try_variant_get(doc, "$.results", "array<variant>")).alias("pos", "result"))
    return rows.where("pos is not null").withColumn("pos", F.col("pos").cast("long"))


def _field(path: str, kind: str, default: Column, strict: bool) -> Column:
    """The value at ``path``: the default if absent; a null stays null if ``strict``, else the default too."""
    found = F.try_variant_get("result", path, "variant")
    value = F.try_variant_get("result", path, kind)
    if not strict:
        return F.when(found.isNull() | F.is_variant_null(found), default).otherwise(value)
    return F.when(found.isNull(), default).otherwise(value)


def flow_fields_of_texts(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add name, speed_ms, jam_factor, free_flow_speed and confidence to rows with a variant ``result``.

    Absent keys give "" and 0 in both modes. An explicit null gives the same by
    default, and stays null with ``strict`` (the provider's "no value"). A value
    of another kind that cannot be cast gives null in both.
    """
    def number(key: str) -> Column:
        return _field(f"$.currentFlow.{key}", "double", F.lit(0.0), strict)

    return (df.withColumn("name", _field("$.location.description", "string", F.lit(""), strict))
            .withColumn("speed_ms", number("speed")).withColumn("jam_factor", number("jamFactor"))
            .withColumn("free_flow_speed", number("freeFlow")).withColumn("confidence", number("confidence")))
