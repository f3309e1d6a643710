"""Scalar metric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
MS_TO_KMH = 3.6
SLOW_KMH = 15          # below: congested band
MEDIUM_KMH = 25        # below: slow band


def kmh(speed_ms: Column, digits: int | None = 2) -> Column:
    """m/s -> km/h, rounded HALF_UP to ``digits`` (None = unrounded)."""
    v = speed_ms * F.lit(MS_TO_KMH)
    return v if digits is None else F.round(v, digits)


def js_round(x: Column) -> Column:
    """JavaScript Math.round: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5))


def speed_band(kmh_col: Column) -> Column:
    """UI colour band: unknown for null/NaN, then <15, <25, else."""
    return (F.when(kmh_col.isNull() | F.isnan(kmh_col), F.lit("unknown"))
            .when(kmh_col < SLOW_KMH, F.lit("slow"))
            .when(kmh_col < MEDIUM_KMH, F.lit("medium"))
            .otherwise(F.lit("fast")))


def flow_value(flow: Column, key: str, default: float = 0.0) -> Column:
    """Read one numeric field of the raw ``currentFlow`` map.

    Absent key -> ``default``; key present with null -> null; an integer
    token such as ``3`` reads as 3.0.
    """
    return (F.when(flow.isNull() | ~F.map_contains_key(flow, F.lit(key)), F.lit(default))
            .otherwise(flow[key].try_cast("double")))
