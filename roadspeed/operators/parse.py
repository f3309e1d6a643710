"""Snapshot parsing: one row per flow result with typed fields and shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shape as S
from ..functions.metrics import flow_value

# Results per snapshot are numbered below this bound inside ``seq``.
SEQ_SLOTS = 1_000_000


def keyed_documents(df: DataFrame) -> DataFrame:
    """Documents with ``doc_key``: the given one, else the landing ``seq``, else a hash of what the document is."""
    own = F.col("seq").cast("string") if "seq" in df.columns else F.lit(None).cast("string")
    given = F.col("doc_key") if "doc_key" in df.columns else F.lit(None).cast("string")
    return df.withColumn("doc_key", F.coalesce(given, own, F.sha2(F.to_json(F.struct("results")), 256)))


def linked(result: Column) -> Column:
    """Whether a result's shape has links."""
    return F.size(F.coalesce(result["location"]["shape"]["links"], F.array())) > 0


def explode_results(df: DataFrame) -> DataFrame:
    """One row per ``results[]`` element, keeping its position ``pos``.

    A record is identified by (``snapshot_ts``, ``doc_key``, ``pos``); ``doc_key`` is
    the document's landing ``seq``, else a hash of where and what it is. ``seq``
    only orders records: ``base * 1e6 + pos`` where base is the document's own
    ``seq``, else the epoch seconds of ``snapshot_ts``, so records of one snapshot
    may share it. A document of 1e6 results or more raises. Other columns pass.
    """
    df = keyed_documents(df)
    keep = [c for c in df.columns if c not in ("results", "seq", "doc_key")]
    # An explicit +0000 offset keeps the key independent of the session time zone.
    epoch = F.unix_seconds(F.to_timestamp(F.concat(F.col("snapshot_ts"), F.lit("+0000")),
                                          "yyyyMMdd'T'HHmmssZ")).cast("long")
    base = F.coalesce(F.col("seq"), epoch) if "seq" in df.columns else epoch
    out = df.select(*keep, "doc_key", base.alias("_base"),
                    # The outer form: else a filter on the array's size is inferred, and the document is parsed for it once more.
                    F.posexplode_outer("results").alias("pos", "result")).where("pos is not null")
    order = F.when(F.col("pos") < SEQ_SLOTS, F.col("_base") * F.lit(SEQ_SLOTS) + F.col("pos")).otherwise(
        F.raise_error(F.lit("a document has a million results or more")).cast("long"))
    return (out.withColumn("seq", order)
               .withColumn("pos", F.col("pos").cast("long")).drop("_base"))


def has_links(df: DataFrame) -> DataFrame:
    """Drop results whose shape has no links (links missing or empty)."""
    return df.filter(linked(F.col("result")))


def flow_fields(df: DataFrame) -> DataFrame:
    """Typed flow values and the description, with the feed's defaults.

    An absent key gives 0, one that is present with null stays null. A typed
    description cannot tell the two apart: both give "" and the name fallbacks
    treat "" and null alike.
    """
    flow = F.col("result.currentFlow")
    return (df
            .withColumn("name", F.coalesce(F.col("result.location.description"), F.lit("")))
            .withColumn("speed_ms", flow_value(flow, "speed"))
            .withColumn("jam_factor", flow_value(flow, "jamFactor"))
            .withColumn("free_flow_speed", flow_value(flow, "freeFlow"))
            .withColumn("confidence", flow_value(flow, "confidence")))


def shape_columns(df: DataFrame) -> DataFrame:
    """Add ``shape`` (rounded points), ``shape_json`` and ``shape_hash``."""
    raw = S.raw_points(F.col("result.location.shape.links"))
    return (df.withColumn("shape", S.round_points(raw))
            .withColumn("shape_json", S.shape_json(raw))
            .withColumn("shape_hash", S.shape_hash(F.col("shape_json"))))


def parse_snapshot(df: DataFrame, watch: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """explode -> drop linkless -> flow fields -> shape; drops the raw struct.

    ``watch`` may observe the exploded results.
    """
    out = shape_columns(flow_fields(has_links(watch(explode_results(df)))))
    return out.drop("result")
