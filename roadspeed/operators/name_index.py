"""Substring search over many segments by posting lists of character grams.

The index holds one row per segment and distinct gram (0 to 3 characters) of its
lower-cased name and its index text, sorted by gram, so that a search reads the
row groups of its own grams and no other names. Postings carry the name, so
nothing has to be fetched for the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 3


def _grams(text: Column, size: int) -> Column:
    """The substrings of ``size`` characters."""
    places = F.sequence(F.lit(1), F.char_length(text) - (size - 1))
    return F.when(F.char_length(text) >= size, F.transform(places, lambda i: F.substring(text, i, F.lit(size)))) \
        .otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame) -> DataFrame:
    """(gram, segment_index, name) of segments (``segment_index``, ``name``); a null name has no text of its own."""
    texts = F.lower(F.coalesce("name", F.lit(""))), F.col("segment_index").cast("string")
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(t, k) for t in texts for k in range(1, LONGEST + 1)]))
    return df.select(F.explode(grams).alias("gram"), "segment_index", "name")


def write_index(df: DataFrame, path: str, files: int | None = None) -> None:
    """Write the postings clustered by (gram, segment_index): a common gram may span several files."""
    keys = ["gram", "segment_index"]
    rows = postings(df)
    spread = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode("error").parquet(path)


def search_index(spark: SparkSession, path: str, q: str) -> DataFrame:
    """(segment_index, name) of ``serving.search_segments``, from the index.

    A text of up to three characters is a gram of its own. A longer one needs all
    of its grams (lists intersected by count, partial sums before the shuffle),
    then the text itself.
    """
    text = (q or "").strip().lower()
    index = spark.read.schema("gram string, segment_index long, name string").parquet(path)
    if len(text) <= LONGEST:
        return index.where(F.col("gram") == text).select("segment_index", "name")
    wanted = sorted({text[i:i + LONGEST] for i in range(len(text) - LONGEST + 1)})
    held = (index.where(F.col("gram").isin(wanted)).groupBy("segment_index", "name")
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)))
    return held.where(F.lower(F.coalesce("name", F.lit(""))).contains(text)
                      | F.col("segment_index").cast("string").contains(text)).select("segment_index", "name")
