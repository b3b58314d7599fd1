"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch. A worker holds some batches at a time, so they bound its memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", app: str = "terselake") -> SparkSession:
    """A session for one machine, as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package to the session's Python workers, once per application, and Arrow batches a size that keeps them small.

    Bounds that the session sets itself are left as they are.
    """
    for key, bound in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, bound)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = tempfile.mkdtemp(prefix="terselake-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root, target = Path(__file__).parent, os.path.join(folder, "terselake.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"terselake/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark
