"""Places that the driver and every executor can reach, and lineage cuts through them."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where that is unset and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="typeloom-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`written` or :func:`scratch` has made, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/typeloom-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone already
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Like ``checkpoint()`` this cuts the lineage with files that survive the loss of executors; the
    columnar copy is smaller and keeps column pruning.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._typeloom_path = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are no longer in use.

    It does so when the driver's JVM finds them unreachable, which may be long after a loop of many joins.
    """
    gc.collect()
    spark._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table from :func:`written` that nothing reads any more."""
    path = getattr(df, "_typeloom_path", None)
    if path:
        delete(df.sparkSession, path)
