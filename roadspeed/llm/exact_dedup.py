"""Exact dedup by a tree-merge of sorted digest runs.

Every map partition turns its rows into one sorted run: a record per distinct
text with the smallest and largest identifier and the number of rows. The
partitions are the corners of a cube with ``fan`` corners on each of ``rounds``
sides; in round ``r`` a partition exchanges runs only with the ``fan`` partitions
that differ from it in digit ``r``, each keeping the texts whose own digit ``r``
equals its position. The runs that arrive are merged in digest order, equal
neighbours folded. After the last round every text has exactly one record.

A text that holds a third of all rows costs one record per map partition in
the first exchange and at most ``fan`` records in a task of any later one.
Identity is SHA-256, and a record is folded into another only when byte length
and an independent 64-bit hash agree as well. Only digests travel, no texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspeed.llm.frames import digest_of, session, shuffle_partitions, text_of

RUN = "slot int, digest binary, n_bytes long, mark long, lo long, hi long, n long"
KEY = ["digest", "n_bytes", "mark"]
#: Spark marks columns that are never null in a batch's schema, which merged records do not have.
RUN_SCHEMA = pa.schema([("slot", pa.int32()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("mark", pa.int64()),
                        ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])


def merge_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold equal neighbours of a partition sorted by KEY; streams, one open record at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).cast(RUN_SCHEMA)
        if held is not None:
            t = pa.concat_tables([held, t])
        t = t.group_by(KEY, use_threads=False).aggregate(
            [("slot", "min"), ("lo", "min"), ("hi", "max"), ("n", "sum")])
        t = pa.table({"slot": t["slot_min"], "digest": t["digest"], "n_bytes": t["n_bytes"], "mark": t["mark"],
                      "lo": t["lo_min"], "hi": t["hi_max"], "n": t["n_sum"]}).sort_by([(k, "ascending") for k in KEY])
        # The last text may go on in the next batch.
        held = t.slice(t.num_rows - 1)
        yield from t.slice(0, t.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def cube(slots: int) -> tuple[int, int]:
    """(fan, rounds) of the smallest cube with at least ``slots`` corners and a fan of at most 16."""
    slots = max(4, slots)
    rounds = max(2, math.ceil(math.log(slots, 16)))
    fan = max(2, math.ceil(round(slots ** (1 / rounds), 9)))
    return fan, rounds


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return df.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"),
                     F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("mark"))


def _digit(of: Column, fan: int, r: int) -> Column:
    return F.floor(of / F.lit(fan ** r)).cast("long") % F.lit(fan)


def text_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int | None = None) -> DataFrame:
    """One record per distinct text: digest, n_bytes, mark, lo, hi, n.

    ``lo`` and ``hi`` are the smallest and largest non-null identifier (null if
    all are null), ``n`` counts rows, repeated identifiers included.
    """
    spark = session(df)
    fan, rounds = cube(slots or shuffle_partitions(spark))
    total = fan ** rounds
    home = F.pmod(F.col("mark"), F.lit(total))
    runs = (_digests(df, id_col, text_col)
            .select((F.spark_partition_id() % total).cast("int").alias("slot"), *KEY,
                    F.col("id").alias("lo"), F.col("id").alias("hi"), F.lit(1).cast("long").alias("n"))
            .sortWithinPartitions(*KEY).mapInArrow(merge_run, RUN))
    for r in range(rounds):
        here = F.col("slot").cast("long")
        to = (here + (_digit(home, fan, r) - _digit(here, fan, r)) * F.lit(fan ** r)).cast("int")
        runs = (runs.withColumn("slot", to).repartitionById(total, F.col("slot"))
                .sortWithinPartitions(*KEY).mapInArrow(merge_run, RUN))
    return runs.drop("slot")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: (id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after no change; null counts as empty. Of
    equal texts the row with the largest (``keep="max"``) or smallest identifier
    stays. Rows that repeat identifier and text are decided together; rows with a
    null identifier stay only if their group has no other identifier. Extra
    columns are ignored, an empty table gives an empty result.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    groups = (text_groups(df, id_col, text_col).where("n > 1")
              .select(*KEY, F.col("hi" if keep == "max" else "lo").alias("best"), "n"))
    rows = _digests(df, id_col, text_col)
    best = F.coalesce(F.col("best"), F.col("id"))
    return rows.join(groups, KEY, "left").select(
        F.col("id").alias(id_col), best.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(best).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row of each text, all columns unchanged: one of the largest (or smallest) identifier.

    Each row is decided by its own identifier and text, so a dropped copy takes no other
    text of its identifier with it; of rows that agree in both one stays. A null
    identifier stays only for a text that has no other.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    groups = text_groups(df, id_col, text_col).where("n > 1").select(
        F.col("digest").alias("_copy_digest"), F.col("hi" if keep == "max" else "lo").alias("_copy_best"))
    rows = df.withColumns({"_id": F.col(id_col).cast("long"), "_digest": digest_of(text_col)})
    alone = rows.join(groups, F.col("_digest") == F.col("_copy_digest"), "left_anti")
    best = rows.join(groups, (F.col("_digest") == F.col("_copy_digest")) & F.col("_id").eqNullSafe(F.col("_copy_best")), "left_semi")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return alone.select(*columns).unionByName(best.dropDuplicates(["_digest"]).select(*columns))
