"""Best-fit packing (operator 3): sum-of-squares placement of document pieces into fixed-size sequences.

Each piece goes where the sum over gaps of (open bins with that gap) squared
becomes smallest; opening a bin counts as a choice too. Tasks pack equal shares
of the pieces by length alone, longest first. Of its bins a task leaves open the
:data:`CARRIED` emptiest, at most, unless nothing that is left could fill them;
those are packed again, each as one item of its filled length, with the open bins of
other tasks. So what goes up a level is a bounded number of rows for each task,
whatever the lengths are, and every level has fewer rows by a fixed factor, until
one bounded task is left. No text or token ids are shuffled.

Cases: null and empty texts have one piece, the end id. A longer document than
the capacity is cut into full pieces and a rest. Repeated rows are packed each.
An empty table gives an empty result. Rows with null doc_id are packed as well.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialise, small_enough, tokenizer_path
from lodestrata.llm.library_tokens import encode_column

CAPACITY = 4096
#: Items packed by one task, and bins that it leaves open for the next level at most.
ROWS_PER_TASK, CARRIED = 24_000, 256
#: A bin with at most this share of its capacity free is not packed again, and how often the others are at most.
NEARLY_FULL, REPACKED = 1 / 256, 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order, and the gap each bin is left with.

    With N(g) open bins of gap g, putting a piece of length s into gap g changes
    the sum of squares by 2 (N(g - s) - N(g)) + 2, filling a bin by 1 - 2 N(s),
    and opening one by 2 N(capacity - s) + 1. Ties: the smallest gap.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    gaps: list[int] = []
    closed = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if not 0 < s <= capacity:
            raise ValueError(f"a piece of length {s} cannot be packed into {capacity}")
        have = count[s:capacity]
        best, cost = capacity, 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if len(have) and have.any():
            change = 2 * (count[: capacity - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = closed
            k = int(change.argmin())
            if change[k] <= cost:
                best = s + k
        if best == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = open_bins[best].pop()
            count[best] -= 1
        bins[i], offsets[i] = b, capacity - gaps[b]
        gaps[b] -= s
        if gaps[b]:
            count[gaps[b]] += 1
            open_bins[gaps[b]].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def pack_items(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`sum_of_squares`, and again for what lies in bins that are not nearly full, as long as that saves a bin."""
    bins, offsets, gaps = sum_of_squares(lengths, capacity)
    for _ in range(REPACKED):
        loose = gaps > capacity * NEARLY_FULL
        at = np.flatnonzero(loose[bins])
        if len(at) == 0:
            break
        own, place, left = sum_of_squares(lengths[at], capacity)
        if len(left) >= loose.sum():
            break
        number = np.cumsum(~loose) - 1
        bins = number[bins]
        bins[at], offsets[at] = own + (~loose).sum(), place
        gaps = np.concatenate([gaps[~loose], left])
    return bins, offsets, gaps


def tokenised_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One narrow row for each piece of each document; the token ids themselves stay in the worker."""
    path = vocabulary or tokenizer_path("word_bpe_49k.json")

    def run(batches):
        for batch in batches:
            ids_of = batch.column(0).cast(pa.int64())
            for i, j, ids, bounds in encode_column(batch.column(1), path):
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = bounds[row] + start
                data = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def _pack(items: DataFrame, keys: list[str], tasks: int, level: int, capacity: int, least: int) -> DataFrame:
    """``items`` with ``sequence_id``, ``offset`` and whether the bin stays ``open``; ``least`` is the shortest item's length."""
    final = tasks == 1

    def run(batches):
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        # Longest first, then by the other columns: the same result in whatever order a task's rows arrive.
        table = pa.Table.from_batches(batches).sort_by([(keys[0], "descending"), *((k, "ascending") for k in keys[1:])]).combine_chunks()
        bins, offsets, gaps = pack_items(table[keys[0]].to_numpy(), capacity)
        free = np.zeros(len(gaps), bool)
        if not final:
            emptiest = np.argsort(-gaps, kind="stable")[:CARRIED]
            free[emptiest[gaps[emptiest] >= least]] = True
        ids = (level << 58) + (TaskContext.get().partitionId() << 34) + bins
        out = table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("open", pa.array(free[bins]))
        yield from out.to_batches()

    schema = items.select("*").schema.add("sequence_id", "long").add("offset", "long").add("open", "boolean")
    # Dealt in turn, not by a key: repeated rows make no task larger than another.
    return materialise(items.repartition(tasks).mapInArrow(run, schema), f"packed{level}")


def _open_bins(packed: DataFrame, length: str) -> DataFrame:
    """bin and filled of the bins that stay open: one row for each."""
    filled = packed.filter("open").groupBy(F.col("sequence_id").alias("bin")).agg(F.max(F.col("offset") + F.col(length)).alias("filled"))
    return materialise(filled, "open")


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``pieces`` (materialised; column ``length`` and any others) with ``sequence_id`` and ``offset``."""
    n, least = pieces.agg(F.count("*"), F.min("length")).first()
    tasks = max(1, -(-n // rows_per_task))
    keys = [c for c in ("length", "doc_id", "piece", "ids_crc32") if c in pieces.columns]
    packed = _pack(pieces, keys, tasks, 0, capacity, least or 0)
    if tasks == 1:
        return packed.drop("open")
    bins, moved, level = _open_bins(packed, "length"), None, 0
    while True:
        n, least = bins.agg(F.count("*"), F.min("filled")).first()
        if not n:
            break
        # Fewer tasks on every level, also where many tasks have few rows each.
        tasks, level = min(-(-n // rows_per_task), -(-tasks // 2)), level + 1
        step = _pack(bins, ["filled", "bin"], tasks, level, capacity, least)
        to = step.select("bin", F.col("sequence_id").alias("to"), F.col("offset").alias("by"))
        if moved is None:
            moved = to
        else:  # where earlier levels have put a bin, moved on by this one
            again = to.select(F.col("bin").alias("to"), F.col("to").alias("next"), F.col("by").alias("more"))
            moved = moved.join(again, "to", "left").select("bin", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
            moved = materialise(moved, "moved")
        if tasks == 1:
            break
        bins = _open_bins(step, "filled")
    out = packed.filter("not open").drop("open")
    if moved is None:
        return out
    moved = F.broadcast(moved) if small_enough(moved) else moved
    again = packed.filter("open").join(moved, F.col("sequence_id") == F.col("bin")).select(*pieces.columns, F.col("to").alias("sequence_id"), (F.col("offset") + F.col("by")).alias("offset"))
    return out.unionByName(again)


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    return pack_lengths(materialise(tokenised_pieces(docs, text, doc_id, capacity, vocabulary), "pieces"), capacity)
