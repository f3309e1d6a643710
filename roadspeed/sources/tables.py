"""Derived tables: transformed runs, speed records, predictions, registry, states.

All are parquet with declared schemas, kept as committed folders (``commits``): a
write is seen whole or not at all, costs the same however much is stored, and is
never a folder per snapshot or date.

* transformed, speed_records  one folder per write, pruned by the range of
  ``snapshot_ts`` in the manifest. Each commit carries the keys (snapshot_ts,
  doc_key) of its documents; documents that the table holds are skipped, so a
  replay or a retry after a crash adds nothing, however documents are grouped.
  Records are range clustered on (segment_index, seq) per write, and over
  writes by ``compact_records``.
* predictions  pruned by ``seq``; (segment_index, seq) that the table holds are skipped.
* registry  extended only by a writer that has seen all rows before.
* states    one folder, replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shape import packed_hash, unpacked_hash
from ..operators.records import identified
from ..schemas import PREDICTIONS, REGISTRY, SPEED_RECORDS, TRANSFORMED
from . import commits as C

IDENTITY = ["snapshot_ts", "doc_key", "pos"]
DOCUMENT = ["snapshot_ts", "doc_key"]
RECORDS = T.StructType(SPEED_RECORDS.fields + [T.StructField("record_date", T.DateType())])
#: Spark's sample rows per range, and the rows that the ranges of a compaction are drawn from (Spark reads three times as many).
RANGE_SAMPLE = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
SAMPLED = 32_000
STORED_PREDICTIONS = T.StructType(PREDICTIONS.fields + [T.StructField("run_date", T.DateType())])


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_transformed(df: DataFrame, path: str, span: tuple | None = None, distinct: bool = True, checked: int | None = None) -> int:
    """Append the rows of new documents, in ranges of (snapshot_ts, seq); returns how many.

    ``span`` is the range of ``snapshot_ts`` where it is known; ``distinct`` drops
    rows that repeat an identity within ``df`` (the ranges are then of the identity, so that the
    rows move once for both); ``checked`` is as in ``commits.append``.
    """
    def ranged(d: DataFrame) -> DataFrame:
        moved = d.withColumn("shape_hash", packed_hash(F.col("shape_hash")))
        moved = moved.repartitionByRange(*IDENTITY).dropDuplicates(IDENTITY) if distinct else moved.repartitionByRange("snapshot_ts", "seq")
        return moved.withColumn("shape_hash", unpacked_hash(F.col("shape_hash")))
    return C.append(_typed(df, TRANSFORMED), path, "snapshot_ts", DOCUMENT, span, ranged, checked)


def read_transformed(spark: SparkSession, path: str, snapshots: list[str] | None = None) -> DataFrame:
    now = C.table(spark, path)
    if snapshots is None:
        return now.read(TRANSFORMED)
    return now.read(TRANSFORMED, min(snapshots, default=""), max(snapshots, default="")).filter(F.col("snapshot_ts").isin(snapshots))


def by_segment(df: DataFrame) -> DataFrame:
    return df.repartitionByRange("segment_index", "seq").sortWithinPartitions("segment_index", "seq")


def append_speed_records(df: DataFrame, path: str, idempotent: bool = True, span: tuple | None = None, distinct: bool = True,
                         checked: int | None = None) -> int:
    """Append records; ``idempotent`` skips documents already stored. Returns the rows written."""
    out = identified(df)
    out = _typed((out.dropDuplicates(IDENTITY) if idempotent and distinct else out)
                 .withColumn("record_date", F.to_date(F.substring("snapshot_ts", 1, 8), "yyyyMMdd")), RECORDS)
    return C.append(out, path, "snapshot_ts", DOCUMENT if idempotent else (), span, by_segment, checked)


def speed_records(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The records; ``since`` and ``until`` (snapshot_ts) leave out folders, and rows, beyond them."""
    if since is None and until is None:
        return C.table(spark, path).read(RECORDS)
    lo, hi = since or "", until or "\U0010ffff"
    return C.table(spark, path).read(RECORDS, lo, hi).where(F.coalesce("snapshot_ts", F.lit("")).between(lo, hi))


def stored_documents(spark: SparkSession, path: str, span: tuple) -> tuple[DataFrame | None, int]:
    """(snapshot_ts, doc_key) of a store's documents around ``span``, and the store's version."""
    now = C.table(spark, path)
    return now.keys(T.StructType([RECORDS[k] for k in DOCUMENT]), *span), now.version


def stored_rows(spark: SparkSession, path: str) -> int:
    """Rows of a table, from its manifest."""
    return C.table(spark, path).rows


def interleaved(a: Column, b: Column) -> Column:
    """A Z-order key: the lower 16 bits of two non-negative numbers, bit by bit in turn."""
    def apart(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x
    return F.shiftleft(apart(a.cast("long")), 1).bitwiseOR(apart(b.cast("long")))


def z_ordered(df: DataFrame, files: int | None = None) -> DataFrame:
    """Rows ranged and sorted by the interleaved bits of (segment_index, seq), each scaled to its range.

    Both a segment's records and a stretch of time then lie in few files and row groups.
    """
    low, high, first, last = df.agg(F.min("segment_index"), F.max("segment_index"), F.min("seq"), F.max("seq")).first()

    def scaled(col: str, lo, hi) -> Column:
        if lo is None or hi == lo:
            return F.lit(0).cast("long")
        share = (F.col(col).cast("double") - float(lo)) / float(hi - lo)
        return F.coalesce(F.floor(share * 65535).cast("long"), F.lit(0).cast("long"))
    keyed = df.withColumn("_z", interleaved(scaled("segment_index", low, high), scaled("seq", first, last)))
    ranged = keyed.repartitionByRange(files, "_z") if files else keyed.repartitionByRange("_z")
    return ranged.sortWithinPartitions("_z", "segment_index", "seq").drop("_z")


def compact_records(spark: SparkSession, path: str, rows: int = 50_000_000, files: int | None = None) -> int:
    """Pack the record store's folders of fewer than ``rows`` rows into one in Z-order; returns how many there were.

    A few files have ranges from a closer sample, as one that misses a cell's edge lets its segments touch another file.
    """
    before = int(spark.conf.get(RANGE_SAMPLE))
    spark.conf.set(RANGE_SAMPLE, max(before, SAMPLED // files if files else 0))
    try:
        return C.compact(spark, path, RECORDS, lambda d: z_ordered(d, files), "snapshot_ts", DOCUMENT, rows)
    finally:
        spark.conf.set(RANGE_SAMPLE, before)


def append_predictions(df: DataFrame, path: str) -> int:
    """Append forecasts; (segment_index, seq) that the table holds are skipped, as a replayed run
    repeats them; only folders of the same ``seq`` are looked at. Returns the rows written."""
    out = _typed(df.withColumn("run_date", F.to_date("Time")), STORED_PREDICTIONS)
    return C.append(out, path, "seq", ["segment_index", "seq"])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return C.table(spark, path).read(STORED_PREDICTIONS)


def extend_registry(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Add ``make(registry)``; if another writer adds rows meanwhile, ``make`` is asked again with those.

    Rows are numbered after the registry's largest index, so no index is given twice,
    neither by two writers nor by a run that is interrupted and repeated.
    """
    return C.extend(spark, path, REGISTRY, lambda known: _typed(make(known), REGISTRY))


def registry(spark: SparkSession, path: str, create: bool = False) -> DataFrame:
    """The registry; with ``create`` one that does not exist yet is empty, else it raises.

    A plain parquet folder without a manifest is read as it is.
    """
    now = C.table(spark, path)
    if now.version or create:
        return now.read(REGISTRY)
    return spark.read.schema(REGISTRY).parquet(path)


def registry_of(spark: SparkSession, path: str, hashes: list[str]) -> DataFrame:
    """Registry rows of some shape hashes: a point read that leaves out row groups by their Bloom filters.

    For a few hashes (Spark pushes up to ``spark.sql.parquet.pushdown.inFilterThreshold`` values one
    by one); many are joined with ``operators.registry.lookup_segments`` or ``new_shapes``.
    """
    return registry(spark, path).where(F.col("shape_hash").isin(hashes))


# --- state tables -------------------------------------------------------------

def read_state(spark: SparkSession, path: str, schema) -> DataFrame:
    """The state table as last committed (empty when it never was)."""
    return C.table(spark, path).read(schema)


def write_state(df: DataFrame, path: str) -> None:
    """Replace the state; the one before stays readable until this one commits, so a failed
    write never loses it."""
    C.replace(df, path)
