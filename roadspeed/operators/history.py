"""Per-segment history: latest value, most recent N, ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY_LEN = 96
#: What identifies a record besides its segment; ``seq`` alone only orders records, and several may share it.
IDENTITY = ("snapshot_ts", "doc_key", "pos")


def _newest_first(columns) -> list:
    return [F.col(c).desc() for c in ("seq", *IDENTITY) if c in columns]


def latest_speed(sr: DataFrame) -> DataFrame:
    """Speed of each segment's newest record, null kept (not skipped).

    ``max_by`` is a partial aggregate: one row per segment per map task is
    shuffled however hot a segment is.
    """
    return sr.groupBy("segment_index").agg(
        F.max_by("Speed", "seq").alias("speed"), F.max("seq").alias("seq"))


def latest_prediction(pr: DataFrame) -> DataFrame:
    """Newest forecast array per segment (null unless it is an array).

    The newest ``seq`` is a hash aggregate; only the arrays it names are then
    fetched. Of rows that share segment and seq one is kept.
    """
    newest = pr.groupBy("segment_index").agg(F.max("seq").alias("seq"))
    found = pr.select("segment_index", "seq", F.col("Speed").alias("predict")).join(newest, ["segment_index", "seq"], "left_semi")
    known = found.dropDuplicates(["segment_index", "seq"])
    return newest.join(known, ["segment_index", "seq"], "left").select("segment_index", "predict", "seq")


def recent_history(sr: DataFrame, n: int = HISTORY_LEN) -> DataFrame:
    """The newest ``n`` records per segment, then nulls dropped.

    The cut is taken before the null filter, so a segment may keep fewer
    than n values. ``age`` is 0 for the newest record. Records of equal ``seq``
    are ordered by their identity where the frame has it. The plan has a
    partial WindowGroupLimit before the exchange, so at most n rows per
    segment per map task are shuffled.
    """
    w = Window.partitionBy("segment_index").orderBy(*_newest_first(sr.columns))
    return (sr.select("segment_index", "seq", "Speed", *[c for c in IDENTITY if c in sr.columns])
            .withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n)
            .filter(F.col("Speed").isNotNull())
            .select("segment_index", "seq", (F.col("_rn") - 1).cast("long").alias("age"),
                    F.col("Speed").alias("speed")))


def empty_recent(spark) -> DataFrame:
    """Initial (empty) state for ``update_recent``."""
    return spark.createDataFrame([], "segment_index long, seq long, Speed double")


def update_recent(state: DataFrame, new_records: DataFrame, n: int = HISTORY_LEN) -> DataFrame:
    """Maintain the newest ``n`` records per segment incrementally.

    ``state`` is the previous output of this function (segment_index, seq,
    Speed, the identity where either frame has it; at most n rows per segment,
    nulls kept). A record outside the old newest n is older than all of them and
    can never re-enter, so the newest n of (state + new) equals the newest n of
    the full history. Each run then costs segments x n rows instead of a scan of
    the whole store. Records without an identity are identified by ``seq``.
    """
    known = [c for c in IDENTITY if c in state.columns or c in new_records.columns]
    unnamed = {"snapshot_ts": F.lit(""), "doc_key": F.col("seq").cast("string"), "pos": F.lit(0).cast("long")}

    def named(df: DataFrame) -> DataFrame:
        return df.select("segment_index", "seq", "Speed", *[
            (F.coalesce(F.col(c), unnamed[c]) if c in df.columns else unnamed[c]).alias(c) for c in known])
    both = named(state).unionByName(named(new_records))
    # The newest n distinct records first (cut before the shuffle, too), then one
    # row of each, as a replayed batch repeats records. The second window is
    # satisfied by the first one's partitioning.
    w = Window.partitionBy("segment_index").orderBy(*_newest_first(both.columns))
    dup = Window.partitionBy("segment_index", "seq", *known).orderBy(F.col("Speed").desc_nulls_last())
    return (both.withColumn("_rank", F.dense_rank().over(w)).filter(F.col("_rank") <= n)
            .withColumn("_d", F.row_number().over(dup)).filter(F.col("_d") == 1)
            .drop("_d", "_rank"))


def series_array(hist: DataFrame, newest_first: bool = True) -> DataFrame:
    """Gather each segment's readings into one ordered array.

    Groups hold at most n rows (after ``recent_history``), so the
    collect is bounded.
    """
    key = F.col("age") if newest_first else -F.col("age")
    return (hist.groupBy("segment_index")
            .agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("speed").alias("v")))).alias("_s"))
            .select("segment_index", F.transform("_s", lambda e: e["v"]).alias("series"))
            .withColumn("n", F.size("series").cast("long")))


def max_history(series: DataFrame) -> DataFrame:
    """Longest series length over all segments (one row)."""
    return series.agg(F.max("n").alias("max_len"))
