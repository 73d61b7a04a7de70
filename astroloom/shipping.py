"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_LOCK = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, through
    Spark's own file distribution; no folder needs to be shared."""
    sc = spark.sparkContext
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        root = Path(__file__).resolve().parent
        if root.is_dir():  # else this is already a shipped copy
            to = Path(tempfile.mkdtemp(prefix="astroloom-")) / "astroloom_package.zip"
            with zipfile.ZipFile(to, "w") as z:
                for p in sorted(root.rglob("*")):
                    if p.is_file() and "__pycache__" not in p.parts:
                        z.write(p, os.path.join("astroloom", p.relative_to(root)))
            sc.addPyFile(str(to))
        _SHIPPED.add(sc.applicationId)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, or of one longer row: the same bound
    for all readers and operators, so that it doesn't matter which set it last."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) != str(BATCH_BYTES):
        spark.conf.set(setting, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``;
    None on one machine where it is unset."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return there
