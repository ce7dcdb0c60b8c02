"""Makes this package importable in Python workers and bounds what they hold."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of rows handed to a Python worker at once: texts and blocks of vectors are long, so a count of rows says little.
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package as a zip with ``addPyFile`` unless ``PYTHONPATH`` already names its folder.

    The driver serves the file; executors fetch it with their first task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    named = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) not in named and app not in _shipped:
        zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tapewright"), "zip", root, "tapewright")
        spark.sparkContext.addPyFile(zipped)
        _shipped.add(app)
    return spark


def give_back() -> None:
    """Return freed memory to the system at the end of a task: a worker outlives it, and others need the room."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
