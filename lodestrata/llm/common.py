"""Shared plumbing: written intermediate tables, checked broadcasts, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many rows of at most ``BROADCAST_ROW_BYTES`` each may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
BROADCAST_ROW_BYTES = 32
#: Bytes of text handled at once inside a Python worker (a single longer text is its own block).
BLOCK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker, which JVM and worker both hold.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Only where that is unset, and Spark runs in one process, a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark itself resolves it to, so that all processes mean the same store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the driver exits."""
    path = qualified(spark, new_path(spark, name))
    atexit.register(_remove_at_exit, spark, path)
    return path


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone; the folder is a scratch folder
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage and survives lost executors. The table is deleted when the
    driver exits, or earlier with :func:`drop`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with bounded_batches(spark):
        df.write.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def bounded_batches(spark: SparkSession):
    """Queries run within it hand rows to Python workers in batches of about ``ARROW_BYTES``, not of a number of rows."""
    before = spark.conf.get(_ARROW, None)
    spark.conf.set(_ARROW, str(ARROW_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_ARROW)
        else:
            spark.conf.set(_ARROW, before)


def drop(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "_written_at", None):
            remove(df.sparkSession, path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column of longs, no two alike, that ascend with doc_id (nulls last); and its name.

    Where no doc_id is null or repeated it is the doc_id itself. Otherwise the rows
    are sorted and written once, with a number each.
    """
    row, key = free_name(docs, "_row"), F.col(doc_id).cast("long")
    odd = docs.select(key.alias("i")).groupBy("i").agg(F.count("*").alias("n")).filter("n > 1 or i is null")
    if odd.isEmpty():
        return docs.withColumn(row, key), row
    order = (key.asc_nulls_last(), F.xxhash64(text), F.monotonically_increasing_id())  # ties are no task's burden
    spread = docs.repartitionByRange(*order).sortWithinPartitions(*order[:2])
    return materialise(spread.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (already materialised) has at most ``rows`` rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def semi_join(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``big`` rows whose ``on`` occurs in ``keys``, without shuffling ``big`` when ``keys`` is small.

    ``keys`` must be materialised and narrow: it is counted, and broadcast only
    under :data:`BROADCAST_ROWS`; otherwise both sides are shuffled.
    """
    keys = keys.select(on)
    return big.join(F.broadcast(keys) if small_enough(keys) else keys, on, "left_semi")


# --- Python workers ---------------------------------------------------------------------

_TOOLS: dict[Any, Any] = {}


def worker_tool(key: Any, make: Callable[[], Any]) -> Any:
    """What a worker process keeps between tasks (a vocabulary and a pool): only one at a time, so that
    a worker that serves one operator after another never holds the tools of all."""
    if key not in _TOOLS:
        release_tools()
        _TOOLS[key] = make()
    return _TOOLS[key]


def release_tools() -> None:
    """Give back what another operator's tasks left in this worker process."""
    if _TOOLS:
        _TOOLS.clear()
        gc.collect()
        try:  # glibc keeps freed memory otherwise
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass


# --- Arrow ----------------------------------------------------------------------------


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    base = int(offsets[0])
    size = int(offsets[-1]) - base
    raw = np.frombuffer(data, np.uint8, size, base) if size else np.zeros(0, np.uint8)
    return raw, offsets - base


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES):
    """Row ranges ``(i, j)`` of about ``size`` bytes of text each; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the package or, failing that, ``/opt/tokenizers``."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
