"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspeed.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is opened by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package shipped to the Python workers."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str) -> Column:
    """The column as text, null as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def digest_of(col: str) -> Column:
    """SHA-256 of the column as text, null as the empty string."""
    return F.unhex(F.sha2(text_of(col), 256))


def same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    """Whether the named columns of two frames agree, null as a value like others."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in columns.items()])


#: What a Python worker keeps from task to task, by operator.
_KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """The operator's place for what its workers keep."""
    return _KEPT.setdefault(owner, {})


def release(owner: str | None = None) -> None:
    """Free what other operators have left in this worker, at the start of a task."""
    held = [v for k, v in _KEPT.items() if k != owner and v]
    for one in held:
        one.clear()
    if held:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def scan_only(df: DataFrame) -> bool:
    """Whether the frame only reads files and maps their rows, so that it gives the same rows in the same order each time."""
    nodes = [line.strip(" :+-!'").split(" ")[0] for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.strip()]
    return bool(nodes) and nodes[-1] == "Relation" and set(nodes) <= {"Project", "Filter", "Relation", "RelationV2"}


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder every node sees, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:") and not folder.startswith("file://"):
            folder = "file://" + folder[5:]
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder
