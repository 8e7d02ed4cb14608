"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch to or from Python, unless the application has set it.
BATCH_BYTES = 8 << 20
#: Bytes of a file split, and of a shuffle's partition where Spark joins small ones, unless the application has set them.
#: The tables compress about tenfold, so Spark's own 128 and 64 MB are millions of rows: one task's sort or hash table passes its memory and spills.
SPLITS = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20}
_SHIPPED: set[str] = set()


def _is_set(spark: SparkSession, key: str) -> bool:
    return bool(spark._jsparkSession.sessionState().conf().contains(key))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors and bound the bytes of Arrow batches, file splits and shuffle partitions, once for each application.

    Without the bound a batch has 10,000 rows, whatever the length of their texts.
    """
    if not _is_set(spark, "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    for key, size in SPLITS.items():
        if not _is_set(spark, key):
            spark.conf.set(key, size)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="typeloom-"), "typeloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
