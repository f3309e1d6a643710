"""Series assembly: padding, matrix form, width, variate position,
instance normalisation, patches. Series are ``array<double>`` columns
(bounded by the history length), so most steps are pure projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wavelet import explode_positions, map_with
from ..plans.ordinal import dense_ordinal

# Fixed values of the forecast network's input layout.
NETWORK_WIDTH = 325
PATCH_LEN = 12
NORM_EPS = 1e-5


def pad_series(df: DataFrame, to: int | None = None, by: str | None = None,
               col: str = "series", shuffle_by_group: bool = False) -> DataFrame:
    """Right-pad ``col`` with 0.0 to a common length.

    ``to`` fixes the length; else the longest series within each ``by``
    group, else the longest overall (one scalar aggregate).
    """
    if to is not None:
        target = F.greatest(F.lit(int(to)), F.size(col))
        out = df
    elif by is not None and shuffle_by_group:
        # Window: the rows move to their group once, and that shuffle also
        # serves a following grouping on the same key (a network scorer).
        out = df.withColumn("_to", F.max(F.size(col)).over(Window.partitionBy(by)))
        target = F.col("_to")
    elif by is not None:
        # Join back a per-group table (one row per group, so bounded); the
        # series keep their partitioning and parallelism.
        lens = df.groupBy(by).agg(F.max(F.size(col)).alias("_to"))
        out = df.join(lens, by)
        target = F.col("_to")
    else:
        top = df.agg(F.max(F.size(col)).alias("m")).first()["m"] or 0
        target = F.lit(int(top))
        out = df
    padded = F.concat(F.col(col), F.array_repeat(F.lit(0.0), (target - F.size(col)).cast("int")))
    return out.withColumn(col, padded).drop("_to")


def series_matrix(df: DataFrame, col: str = "series", key: str = "segment_index") -> DataFrame:
    """Long form of the time x segment matrix: (key, pos, value)."""
    return df.select(key, *[c for c in ("network", "variate") if c in df.columns],
                     explode_positions(F.col(col), "pos", "value")).filter(F.col("pos").isNotNull())


def series_matrix_wide(matrix: DataFrame, width: int | None = None) -> DataFrame:
    """Wide export of a width-padded long matrix: one row per (network,
    pos), one column per variate ``"0"`` .. ``str(width-1)``.

    Without ``width`` there are as many columns as the matrix has variates,
    NETWORK_WIDTH at least. A variate beyond a given ``width`` raises.
    """
    top = matrix.agg(F.max("variate").alias("m")).first()["m"]
    have = 0 if top is None else int(top) + 1
    if width is not None and have > width:
        raise ValueError(f"the matrix has {have} variates, more than {width}")
    width = width or max(NETWORK_WIDTH, have)
    return (matrix.groupBy("network", "pos")
            .pivot("variate", list(range(width)))
            .agg(F.first("value")))


def variate_position(df: DataFrame, width: int = NETWORK_WIDTH) -> DataFrame:
    """Network and column of each series: rank by segment_index, ``width``
    series per network (one network while there are <= width segments)."""
    # Only the keys are numbered and checkpointed; the series are joined back.
    ranked = df.join(dense_ordinal(df.select("segment_index"), "segment_index", "_ord", start=0), "segment_index")
    return (ranked.withColumn("network", F.floor(F.col("_ord") / width).cast("long"))
            .withColumn("variate", (F.col("_ord") % width).cast("long")).drop("_ord"))


def target_width(n_series: F.Column, width: int = NETWORK_WIDTH) -> F.Column:
    """``width``, or the smallest power of two >= n when n exceeds it."""
    pow2 = F.pow(F.lit(2.0), F.ceil(F.log2(n_series.cast("double")))).cast("long")
    return F.when(n_series <= width, F.lit(width).cast("long")).otherwise(pow2)


def pad_width(matrix: DataFrame, width: int = NETWORK_WIDTH) -> DataFrame:
    """Add all-zero variates on the right up to the target width.

    Input is the long matrix (network, variate, pos, value); the zero rows
    are generated per network from its own shape, without a join.
    """
    shape = matrix.groupBy("network").agg(
        (F.max("variate") + 1).alias("_w"), (F.max("pos") + 1).alias("_t"))
    zeros = (shape.withColumn("_tw", target_width(F.col("_w"), width))
             .filter(F.col("_tw") > F.col("_w"))
             .select("network", F.explode(F.sequence(F.col("_w"), F.col("_tw") - 1)).alias("variate"), "_t")
             .select("network", "variate", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("pos"))
             .select("network", F.col("variate").cast("long"), F.col("pos").cast("int"), F.lit(0.0).alias("value")))
    return matrix.select("network", "variate", "pos", "value").unionByName(zeros)


def instance_norm(df: DataFrame, col: str = "series") -> DataFrame:
    """(x - mean) / sqrt(var_pop + 1e-5) per series; keeps mean and stdev."""
    n = F.size(col).cast("double")
    # try_divide: an empty series gives null statistics instead of an error.
    mean = F.try_divide(F.aggregate(col, F.lit(0.0), lambda a, v: a + v), n)
    out = df.withColumn("mean", mean)
    sq = map_with(F.col(col), F.col("mean"), lambda v, m: (v - m) * (v - m))
    var = F.try_divide(F.aggregate(sq, F.lit(0.0), lambda a, v: a + v), n)
    out = out.withColumn("stdev", F.sqrt(var + F.lit(NORM_EPS)))
    stats = F.struct(F.col("mean").alias("m"), F.col("stdev").alias("s"))
    return out.withColumn("normed", map_with(F.col(col), stats, lambda v, st: (v - st["m"]) / st["s"]))


def denormalize(df: DataFrame, col: str = "forecast") -> DataFrame:
    """Undo instance_norm on a forecast: v * stdev + mean."""
    stats = F.struct(F.col("mean").alias("m"), F.col("stdev").alias("s"))
    return df.withColumn(col, map_with(F.col(col), stats, lambda v, st: v * st["s"] + st["m"]))


def patches(df: DataFrame, col: str = "series", size: int = PATCH_LEN) -> DataFrame:
    """Non-overlapping patches of ``size``; an incomplete tail is dropped."""
    k = F.floor(F.size(col) / size).cast("int")
    arr = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.slice(col, i * size + 1, size))
    arr = F.when(k > 0, arr).otherwise(F.array().cast("array<array<double>>"))
    return df.select(*[c for c in df.columns if c != col],
                     explode_positions(arr, "patch", "values")).filter(F.col("patch").isNotNull())
