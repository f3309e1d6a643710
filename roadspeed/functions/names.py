"""Name fallbacks used by the registry, the API and the UI."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry_name(name: Column, segment_index: Column) -> Column:
    """Registry keeps the description, or ``segment_{n}`` when it is empty."""
    return F.when(name.isNull() | (name == ""),
                  F.concat(F.lit("segment_"), segment_index.cast("string"))).otherwise(name)


def api_name(name: Column) -> Column:
    """The segment list serves ``""`` when the name is missing."""
    return F.coalesce(name, F.lit(""))


def display_name(name: Column, segment_index: Column) -> Column:
    """The UI shows ``Segment #n`` when the name is empty."""
    return F.when(name.isNull() | (name == ""),
                  F.concat(F.lit("Segment #"), segment_index.cast("string"))).otherwise(name)
