"""Segment registry: content-hash identity and dense surrogate keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import registry_name
from ..functions.shape import packed_hash, unpacked_hash
from ..plans.ordinal import dense_ordinal
from ..schemas import REGISTRY
from ..session import kept

COUNTER_KEY = "__COUNTER__"


def drop_sentinel(registry: DataFrame) -> DataFrame:
    """Remove the counter row an imported key-value registry may carry."""
    return registry.filter(F.col("shape_hash").isNull() | (F.col("shape_hash") != COUNTER_KEY))


def first_seen(records: DataFrame) -> DataFrame:
    """One row per shape hash: name and shape of its earliest record.

    The records are read once: the earliest (seq, name, shape) is an aggregate with partial
    results before the shuffle, so a hash that holds a large share of the rows costs one row
    per map task, and no text is shuffled twice.
    """
    # The nulls are asked for inside the aggregate: a filter on the hash would be pushed below and compute the text once more.
    known = F.col("shape_hash").isNotNull() & F.col("seq").isNotNull()
    earliest = (records.groupBy("shape_hash").agg(F.min(F.when(known, F.struct("seq", "name", "shape_json"))).alias("_first"))
                .where(F.col("_first").isNotNull()))
    return earliest.select("shape_hash", F.col("_first.seq").alias("first_seq"), "_first.name", "_first.shape_json")


def _described(records: DataFrame, first: DataFrame) -> DataFrame:
    """Add name and shape text of the record (shape_hash, first_seq) to each row of ``first``."""
    texts = (records.select("shape_hash", F.col("seq").alias("first_seq"), "name", "shape_json")
             .join(first, ["shape_hash", "first_seq"], "left_semi").dropDuplicates(["shape_hash", "first_seq"]))
    return first.join(texts, ["shape_hash", "first_seq"]).select("shape_hash", "first_seq", "name", "shape_json")


def new_shapes(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Records whose shape hash the registry does not hold yet."""
    return records.join(registry.select("shape_hash"), "shape_hash", "left_anti")


def empty_registry(spark) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


def register_new(records: DataFrame, registry: DataFrame, created_at=None,
                 keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """Registry rows for shapes seen for the first time.

    New shapes are numbered densely after the current maximum index, in
    first-seen order (``seq``). Only new distinct shapes are numbered, and
    the numbering is bucketed (no single-task window). Replaying the same
    records against the updated registry yields no rows. ``keep`` computes the new
    shapes once, as they are read several times.
    """
    # Aggregate first: the minimum is partial before its shuffle, so a shape that
    # holds a large share of the records never lands whole in one task; the
    # anti-join then runs on distinct shapes, and texts are fetched for new ones only.
    first = records.groupBy("shape_hash").agg(F.min("seq").alias("first_seq"))
    fresh = keep(_described(records, new_shapes(first, registry)), "new-shapes")
    top = registry.agg(F.max("segment_index").alias("m")).first()["m"]
    start = int(top or 0) + 1
    numbered = dense_ordinal(fresh, "first_seq", "segment_index", start=start, then=("shape_hash",), materialize=False)
    stamp = (F.current_timestamp() if created_at is None else F.lit(created_at)).cast("timestamp_ntz")
    return numbered.select(
        "shape_hash", "segment_index",
        registry_name(F.col("name"), F.col("segment_index")).alias("name"),
        F.col("shape_json").alias("shape"),
        stamp.alias("created_at"),
        "first_seq")


def register_segments(records: DataFrame, registry: DataFrame, created_at=None) -> DataFrame:
    """``registry`` plus the rows of newly seen shapes."""
    return registry.select(*REGISTRY.fieldNames()).unionByName(register_new(records, registry, created_at))


def attach_segment(records: DataFrame, registry: DataFrame) -> DataFrame:
    """Give every record its segment_index (left join on the hash).

    The registry is the small side; AQE turns this into a broadcast join
    when the runtime size is under the broadcast threshold and keeps a
    shuffled join otherwise, which moves the hashes as bytes.
    """
    index = registry.select(packed_hash(F.col("shape_hash")).alias("_hash"), "segment_index")
    joined = records.withColumn("_hash", packed_hash(F.col("shape_hash"))).drop("shape_hash").join(index, "_hash", "left")
    return joined.select(unpacked_hash(F.col("_hash")).alias("shape_hash"), *[c for c in records.columns if c != "shape_hash"], "segment_index")


def lookup_segments(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Keyed enrichment: name and shape text for each requested index."""
    return keys.join(registry.select("segment_index", "name", "shape"), "segment_index", "inner")
