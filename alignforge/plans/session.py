"""Session helpers."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: the one bound of an Arrow batch, whatever the operator
BATCH_ROWS, BATCH_MB = 1000, 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="alignforge-ship-"))
    shutil.copytree(root, to / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(to / "alignforge"), "zip", to / "src"))
    _shipped.add(sc.applicationId)


def _number(setting: str) -> int:
    """A count or size of the session's settings: 10000, 64m, 67108864b."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)b?\s*", setting.lower())
    return int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[m[2]] if m else 0


def small_batches(spark: SparkSession) -> None:
    """Before Python work: ship the package, and bound an Arrow batch by rows and bytes.

    All operators share one bound, so the order in which lazy plans are built and run does not
    matter; a tighter bound of the caller's stays. No result depends on how batches fall.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_MB << 20)):
        now = _number(str(spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder (driver and executors are one
    process); a cluster must name a shared folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="alignforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write are freed when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Remove tables written by :func:`saved` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_saved_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
