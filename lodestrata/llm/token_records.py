"""Token-ID output (operator 9): length-delimited binary records with masked checksums and an offset index.

A shard ``part-NNNNN.rec`` is a run of records::

    uint64 length | uint32 masked checksum of the length | payload | uint32 masked checksum of the payload

and a payload is ``uint8 flags, uint8 width, int64 doc_id`` and the ids, ``width``
bytes each (2 where the vocabulary allows, else 4), all little-endian; flag 1
marks a null doc_id. ``part-NNNNN.idx`` holds, for shuffled reads, one
``int64 doc_id, uint64 offset, uint64 length`` entry for each record. The
checksum is zlib's CRC-32, masked by a rotation and an addition so that a
checksum of data that holds checksums stays sound.

Texts are range-partitioned and sorted by doc_id (ties by a hash of the text and
a row number, so that one repeated id, or row, is not one task's burden), encoded
and streamed to the shard of their partition, of which there is one for each
:data:`SHARD_BYTES` of text; a shard appears under its name only when it is
whole, and a repeated task writes the same bytes. Only one row for each shard
reaches the driver. Paths are qualified by Spark once, so that every executor
writes to the same store; ``file:`` must be a folder that all of them share.

Cases: null and empty texts are records with the end id alone; null ids come
first; repeated rows are records of their own; an empty table has no records.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, qualified, scratch_path, tokenizer_path
from lodestrata.llm.library_tokens import encode_column

#: Fixed values of the record format: rotation and constant of the checksum's mask.
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8
_HEAD = struct.Struct("<BBq")
_INDEX = struct.Struct("<qQQ")
#: Bytes of text of one shard, and the least for which cores that would be idle get a shard of their own.
SHARD_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
#: Index entries read at once.
INDEX_ROWS = 8192
MANIFEST = "shard int, path string, records long, tokens long"


def masked_crc(data) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_ROTATE) | (c << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def record(doc_id: int | None, width: int, ids: bytes) -> bytes:
    return frame(_HEAD.pack(doc_id is None, width, doc_id or 0) + ids)


def index_entry(doc_id: int | None, at: int, size: int) -> bytes:
    return _INDEX.pack(doc_id or 0, at, size)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (fs.LocalFileSystem(), path)


def shards_for(docs: DataFrame, text: str) -> int:
    """One shard for each ``SHARD_BYTES`` of text, and no idle cores where there is less."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // SHARD_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, total // LEAST_BYTES))


def write_records(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, partitions: int | None = None, width: int = 2) -> DataFrame:
    """Write ``docs`` in ascending doc_id order to shards under ``path``; one manifest row for each shard."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokenizer_path("word_bpe_49k.json")
    path = qualified(spark, path)
    n = partitions or shards_for(docs, text)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        store, base = _filesystem(path)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{shard:05d}"
        tmp = f"{base}/.part-{shard:05d}-{task.taskAttemptId()}"
        at = records = tokens = 0
        with store.open_output_stream(f"{tmp}.rec") as out, store.open_output_stream(f"{tmp}.idx") as index:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for i, j, ids, bounds in encode_column(batch.column(1), vocabulary):
                    data = ids.astype("<u2" if width == 2 else "<u4").tobytes()
                    if width == 2 and len(ids) and int(ids.max()) > 0xFFFF:
                        raise ValueError("an id does not fit two bytes")
                    for k in range(j - i):
                        key = keys[i + k]
                        framed = record(key, width, data[width * bounds[k] : width * bounds[k + 1]])
                        out.write(framed)
                        index.write(index_entry(key, at, len(framed)))
                        at += len(framed)
                    records += j - i
                    tokens += len(ids)
        if records:
            for kind in ("rec", "idx"):
                store.move(f"{tmp}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{path}/part-{shard:05d}", "records": records, "tokens": tokens}], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())]))
        else:
            for kind in ("rec", "idx"):
                store.delete_file(f"{tmp}.{kind}")

    key, tie = F.col("doc_id").asc_nulls_first(), (F.xxhash64("text"), F.monotonically_increasing_id())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(rows.repartitionByRange(n, key, *tie).sortWithinPartitions(key, tie[0]).mapInArrow(run, MANIFEST), "manifest")


def iterate_shard(path: str):
    """Yields ``(doc_id, ids)`` of one shard in order, finding records by the index and checking every checksum."""
    store, base = _filesystem(path)
    with store.open_input_stream(f"{base}.idx") as index, store.open_input_file(f"{base}.rec") as f:
        while entries := index.read(_INDEX.size * INDEX_ROWS):
            for _, at, size in _INDEX.iter_unpack(entries):
                yield read_record(f, at, size)


def read_record(f, at: int, size: int) -> tuple[int | None, np.ndarray]:
    """One record of an open shard, as its index entry places it."""
    f.seek(at)
    data = f.read(size)
    length, check = struct.unpack_from("<QI", data)
    payload = data[12:-4]
    if masked_crc(data[:8]) != check or length != len(payload) or masked_crc(payload) != struct.unpack("<I", data[-4:])[0]:
        raise OSError(f"a damaged record at {at}")
    null, width, doc_id = _HEAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read back from the shards."""
    shards, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.shard):  # one row for each shard, not for each document
        shards.append((r.path, start))
        start += r.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    names = schema.replace(" long", "").split(", ")

    def run(batches):
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for doc_id, ids in iterate_shard(path):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return spark.createDataFrame(shards, "path string, start long").repartition(len(shards)).mapInArrow(run, schema)


def token_records(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write all of ``docs`` and read the files back; see :func:`write_records` and :func:`read_records`."""
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, path or scratch_path(spark, "records"), **options))
