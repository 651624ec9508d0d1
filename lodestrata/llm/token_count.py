"""Token counts (operator 2): byte-level BPE by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a block lie one after another in a flat array of
symbols. Every round finds each sequence's lowest-ranked pair and merges all its
occurrences, in all sequences at once; sequences without a mergeable pair leave
the arrays, and what is left of each is its tokens. Merges that build a symbol
always come before those that use it, so merging all occurrences of the lowest
pair at once gives what one merge at a time gives.

Cases: null and empty texts count 0 tokens and 0 bytes. A special token's name
inside a text is that one token, as is the library's default. Very long texts
are counted whole. Repeated rows are counted each; an empty table gives none.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, text_buffers, tokenizer_path, worker_tool
from lodestrata.llm.library_tokens import byte_letters
from lodestrata.llm.pretoken import GPT_PATTERN, UnitPool, compile_pattern, encode_by_pattern, space_units
from lodestrata.llm.textops import ragged_index, sums_by_range

_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Ranks and results of the merges in a ``tokenizers`` file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in merges], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the largest int32 where there is no merge."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def merge_all(table: MergeTable, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sequences one after another, and each sequence's count.

    ``symbols`` holds the sequences; ``starts`` their first positions (none is empty).
    """
    n = len(starts)
    sizes = np.diff(np.append(starts, len(symbols)))
    result: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sym, own = symbols.astype(np.int32), np.repeat(np.arange(n), sizes)
    rank = np.full(len(sym), _NONE, np.int32)  # of the pair that begins here
    same = own[1:] == own[:-1]
    rank[:-1][same] = table.rank(sym[:-1][same], sym[1:][same])
    while len(sym):
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(first, len(sym)))
        low = np.minimum.reduceat(rank, first)
        over = low == _NONE
        if over.any():
            gone = np.repeat(over, size)
            result.append((own[first[over]], size[over], sym[gone]))
            sym, own, rank = sym[~gone], own[~gone], rank[~gone]
            if not len(sym):
                break
            size, low = size[~over], low[~over]
        at = np.flatnonzero(rank == np.repeat(low, size))
        # In a run of overlapping occurrences (a a a) every other one is merged, from the left.
        chain = np.append(False, (at[1:] == at[:-1] + 1) & (own[at[1:]] == own[at[:-1]]))
        if chain.any():
            head = np.maximum.accumulate(np.where(chain, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
        sym[at] = table.result[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        where = np.cumsum(keep) - 1
        sym, own, rank = sym[keep], own[keep], rank[keep]
        at = where[at]
        touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[touched] = _NONE
        touched = touched[touched < len(sym) - 1]
        touched = touched[own[touched] == own[touched + 1]]
        rank[touched] = table.rank(sym[touched], sym[touched + 1])
    count = np.zeros(n, np.int64)
    for who, size, _ in result:
        count[who] = size
    first = np.cumsum(count) - count
    flat = np.empty(int(count.sum()), np.int32)
    for who, size, tokens in result:
        flat[ragged_index(first[who], size)] = tokens
    return flat, count


_PATTERN = compile_pattern(GPT_PATTERN)


def _tools(path: str) -> tuple[MergeTable, UnitPool]:
    def make():
        table = MergeTable(path)
        return table, UnitPool(encode_by_pattern(_PATTERN, partial(merge_all, table), table.byte_ids))

    return worker_tool(("count", path), make)


def count_block(raw: np.ndarray, offsets: np.ndarray, path: str) -> np.ndarray:
    """Tokens of each text of a block."""
    table, pool = _tools(path)
    data = None
    for name in table.special:
        if len(raw) >= len(name) and (raw == ord(name[0])).any() and name.encode() in (data := data or raw.tobytes()):
            return _count_with_special(data, offsets, path)
    starts, ends, first = space_units(raw, offsets, _PATTERN)
    rows = pool.rows(raw, starts, ends)
    return sums_by_range(pool.count[rows], first)


def _count_with_special(data: bytes, offsets: np.ndarray, path: str) -> np.ndarray:
    """As :func:`count_block`, where some text names a special token: the stretches between names are counted alone."""
    table, pool = _tools(path)
    names = sorted((n.encode() for n in table.special), key=len, reverse=True)
    pieces, owner, extra = [], [], np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(offsets) - 1):
        parts = [data[offsets[d] : offsets[d + 1]]]
        for name in names:
            split = [p.split(name) for p in parts]
            extra[d] += sum(len(p) - 1 for p in split)
            parts = [q for p in split for q in p]
        pieces += parts
        owner += [d] * len(parts)
    at = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) for p in pieces], out=at[1:])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    starts, ends, first = space_units(raw, at, _PATTERN)
    rows = pool.rows(raw, starts, ends)
    np.add.at(extra, owner, sums_by_range(pool.count[rows], first))
    return extra


def count_tokens(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each document, without a shuffle."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            count = np.zeros(batch.num_rows, np.int64)
            for i, j in blocks(offsets):
                count[i:j] = count_block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(count), pa.array(count > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
