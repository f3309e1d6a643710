"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Configs that make results reproducible and the plans adaptive.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoint files of finished micro-batches are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "roadspeed", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the project defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small ones).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The setting is read from the session (``spark.checkpoint.dir``). Where it is
    unset a local master gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        conf_dir = tempfile.mkdtemp(prefix="roadspeed-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a local tmp)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes started here give back the disk of their shuffles when they end, not when the driver collects garbage."""
    before = spark.conf.get(FREES_SHUFFLES, None)
    spark.conf.set(FREES_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREES_SHUFFLES)
        else:
            spark.conf.set(FREES_SHUFFLES, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The frame, computed once: written to the shared folder, compressed and by column, and reread.

    A checkpoint keeps uncompressed whole rows, of which every reader reads all.
    """
    return _kept_at(df, scratch_path(df.sparkSession, name))


def _kept_at(df: DataFrame, folder: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Kept:
    """Frames of a run, kept as ``kept`` does until they are dropped by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        folder = scratch_path(self.spark, name)
        self.folders.append((name, folder))
        return _kept_at(df, folder)

    def drop(self, *names: str) -> None:
        """Remove the folders of these frames, of all without names; nothing may read them any more."""
        gone = [f for f in self.folders if not names or f[0] in names]
        for one in gone:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(one[1])
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            self.folders.remove(one)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``roadspeed`` importable in Python workers (``addPyFile``).

    Only the cross-series scorer runs Python on executors; its closure
    refers to this package, so the package is zipped once per application
    and shipped like ``--py-files`` would.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="roadspeed-pyfiles-"), "roadspeed.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)
