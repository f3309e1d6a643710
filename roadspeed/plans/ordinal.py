"""Dense global numbering without a single-task window.

``row_number() over (order by k)`` with no partition runs in one task. Here
the key range is cut into equal-frequency buckets (approximate quantiles,
a distributed sketch), each bucket is numbered by a partitioned window, and
a bounded table of per-bucket offsets (at most ``buckets`` rows) is
broadcast back. Keys must be unique for the numbering to be deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 256


def dense_ordinal(df: DataFrame, order_col: str, out_col: str = "ordinal",
                  start: int | str = 1, buckets: int = DEFAULT_BUCKETS,
                  materialize: bool = True, then: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out_col`` = start + rank of ``order_col`` (0-based rank).

    Equal ``order_col`` values are numbered in the order of the columns ``then``.
    ``start`` may be a column name holding one constant value (e.g. a
    broadcast ``max(index) + 1``). The input is read three times (bounds,
    counts, numbering), so by default it is checkpointed once to the shared
    checkpoint folder; callers pass already-aggregated, bounded inputs
    (new distinct shapes, segments).
    """
    if materialize:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10_000).alias("q")).first()
    bounds = sorted(set(v for v in (row["q"] or []) if v is not None))
    bound_arr = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    key = F.col(order_col).cast("double")
    bucketed = df.withColumn("_bucket", F.size(F.filter(bound_arr, lambda b: b < key)))
    counts = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    # offsets has at most `buckets` rows: a proven bound for the broadcast.
    numbered = (bucketed.join(F.broadcast(offsets), "_bucket")
                .withColumn("_r", F.row_number().over(Window.partitionBy("_bucket").orderBy(order_col, *then))))
    base = F.lit(start) if isinstance(start, int) else F.col(start)
    return (numbered.withColumn(out_col, (base + F.coalesce(F.col("_off"), F.lit(0)) + F.col("_r") - 1).cast("long"))
            .drop("_bucket", "_off", "_r"))
