"""Intermediate tables in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset, and Spark runs in one process, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def usable(spark: SparkSession) -> bool:
    """Whether there is such a folder."""
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.sparkContext.master.startswith("local"))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is a scratch folder
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that was written: its lineage and its plan's constraints end here, and it outlives its executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "_written_at", None):
            _remove(df.sparkSession, path)
