"""Raw snapshot landing and reading (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW_SNAPSHOT

TS_PATTERN = r"(\d{8}T\d{6})"


def raw_read_schema() -> T.StructType:
    """Document schema plus the ``snapshot_ts`` partition column."""
    return T.StructType(RAW_SNAPSHOT.fields + [T.StructField("snapshot_ts", T.StringType())])


CORRUPT = "_corrupt_record"


def _keyed(df: DataFrame, file_path: Column | None = None, file_name: Column | None = None) -> DataFrame:
    """(results, seq, snapshot_ts, doc_key) of parsed documents."""
    file_path = F.col("_metadata.file_path") if file_path is None else file_path
    file_name = F.col("_metadata.file_name") if file_name is None else file_name
    from_name = F.regexp_extract(file_name, TS_PATTERN, 1)
    ts = F.coalesce(F.col("snapshot_ts"), F.when(from_name != "", from_name))
    # A document without landing number is known by where and what it is.
    key = F.coalesce(F.col("seq").cast("string"),
                     F.sha2(F.concat_ws("|", file_path, F.to_json(F.struct("results"))), 256))
    return df.select("results", "seq", ts.alias("snapshot_ts"), key.alias("doc_key"))


def read_with_quarantine(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): every input is in one of the two; rejected ones as (file_path, value)."""
    schema = T.StructType(raw_read_schema().fields + [T.StructField(CORRUPT, T.StringType())])
    text = spark.read.text(path, wholetext=multi_line)
    doc = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    folder = F.col("snapshot_ts").cast("string") if "snapshot_ts" in text.columns else F.lit(None).cast("string")
    df = text.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
                     folder.alias("folder"), doc.alias("doc"))
    bad = F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull()
    good = df.filter(~bad).select("doc.results", "doc.seq", F.coalesce("folder", "doc.snapshot_ts").alias("snapshot_ts"),
                                  "file_path", "file_name")
    return _keyed(good, F.col("file_path"), F.col("file_name")), df.filter(bad).select("file_path", "value")


def read_snapshots(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read landed snapshots: (results, seq, snapshot_ts, doc_key). A malformed document fails the
    read; ``read_with_quarantine`` sets such ones apart instead.

    JSON Lines by default (splittable); ``multi_line=True`` for one
    pretty-printed document per file, as a provider response is landed.
    The snapshot key comes from the ``snapshot_ts=`` folder, else from a
    ``YYYYMMDDTHHMMSS`` stamp in the file name.
    """
    return _keyed(spark.read.schema(raw_read_schema()).option("multiLine", multi_line)
                  .option("mode", "FAILFAST").json(path))


def stream_snapshots(spark: SparkSession, path: str, max_files: int | None = None,
                     multi_line: bool = False) -> DataFrame:
    """The same source as an unbounded stream (new files = new snapshots)."""
    r = spark.readStream.schema(raw_read_schema()).option("multiLine", multi_line).option("mode", "FAILFAST")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return _keyed(r.json(path))


def write_raw(docs: DataFrame, path: str, by_snapshot: bool = True) -> None:
    """Land raw documents (``snapshot_ts``, ``value`` JSON text) as text;
    appends, so every run keeps its payload.

    ``by_snapshot`` writes one folder per snapshot (the run layout); range
    partitioning keeps a back-fill of many snapshots at about one file per
    folder and ``seq`` (when present) splits one large snapshot. Documents
    that carry their own ``snapshot_ts`` can be landed flat instead.
    """
    keys = ["snapshot_ts"] + (["seq"] if "seq" in docs.columns else [])
    spread = docs.repartitionByRange(*keys)
    if by_snapshot:
        spread.select("snapshot_ts", "value").write.mode("append").partitionBy("snapshot_ts").text(path)
    else:
        spread.select("value").write.mode("append").text(path)
