"""Token counts by a map-side two-tier lookup.

A first pass keeps, per partition, a bounded summary of the most frequent
pre-tokens (Misra-Gries: one with more than 1/``width`` of a partition's
pre-tokens is never lost); the sums of the summaries give the ``size`` most
frequent pre-tokens of the whole table. Their token lengths are computed once and
broadcast. The second pass adds up lengths from that table; a pre-token that it
lacks is encoded by the library once per worker and kept in its bounded cache.
Pre-tokens of documents are never shuffled, only the summaries are.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspeed.llm.frames import session, text_of
from roadspeed.llm.pretokens import CachedEncoder, Splitter

LIMIT = 2048
#: Entries of the broadcast table, and of a partition's summary. Longer pre-tokens are not entered.
TABLE, WIDTH, LONGEST = 20_000, 2_000, 32


def shrink(counts: Counter, width: int) -> Counter:
    """At most ``width`` counters: subtract the next largest count from all and drop what is left without."""
    if len(counts) <= width:
        return counts
    cut = sorted(counts.values(), reverse=True)[width]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def _summaries(spec: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = Splitter(spec), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for tokens in splitter.split(text) or ():
                    counts.update(tokens)
                if len(counts) > 20 * width:
                    counts = shrink(counts, width)
        counts = shrink(counts, width)
        keep = [(k, n) for k, n in counts.items() if len(k) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], pa.string()),
                                          pa.array([n for _, n in keep], pa.int64())], ["token", "n"])
    return run


def frequent_lengths(df: DataFrame, path: str, text_col: str = "text", size: int = TABLE, width: int = WIDTH) -> dict[str, int]:
    """Token lengths of the table's most frequent pre-tokens, at most ``size`` of at most 32 characters."""
    session(df)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    top = (df.select(text_of(text_col)).mapInArrow(_summaries(spec, width), "token string, n long")
           .groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size).select("token"))
    tokens = [r.token for r in top.collect()]
    return dict(zip(tokens, CachedEncoder(path, len).encode(tokens)))


class Frequent:
    """The broadcast table, with a name by which a worker knows it again."""

    def __init__(self, spark: SparkSession, lengths: dict[str, int]):
        self.sent, self.id = spark.sparkContext.broadcast(lengths), uuid.uuid4().hex

    @property
    def value(self) -> dict[str, int]:
        return self.sent.value


def _count(path: str, shared):
    def run(batches):
        encoder = CachedEncoder.kept((path, "counts", shared.id), lambda: CachedEncoder(path, len, shared.value))
        for batch in batches:
            counts = [sum(map(sum, lists)) for lists in encoder.values(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])
    return run


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 table: dict[str, int] | None = None) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` is a tokenizer file that every worker can open. Null counts as empty
    (0 tokens); strings of special tokens in a text are treated as the library does
    by default; nothing is truncated. Repeated rows are counted each on its own.
    """
    spark = session(df)
    shared = Frequent(spark, frequent_lengths(df, path, text_col) if table is None else table)
    text = text_of(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(_count(path, shared), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
