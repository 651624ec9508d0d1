"""Byte-level BPE encoding and decoding (operator 6): corpus-level merge replay.

The distinct pre-tokens of a block of the corpus are laid out once as a doubly
linked list of symbols. An inverted index leads from a pair's rank to the
positions where the pair stands; ranks are taken lowest first, each merge is
applied at all its positions in all words at once, and only the neighbours of
the merged symbols get new index entries. Documents then look their words up.

Ranks of the rank file are those of the merged bytes, and a merge can create a
pair with a lower rank than its own. Such merges are found from the vocabulary;
for them only the leftmost position of each word is merged before the index is
asked again, so the result is that of merging one lowest pair at a time.

Each text is cut into words once. The words of a block of texts (:data:`REPLAY_BYTES`)
that a bounded pool does not know yet are merged together, so memory does not grow
with the corpus; the README says why blocks and not the whole corpus's vocabulary.

Cases: null and empty texts have no tokens. Special tokens do not exist: their
names are ordinary text. Very long texts and words are encoded whole. Repeated
rows are encoded each; an empty table gives none. Decoding is exact: the bytes
of the ids are the bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import blocks, text_buffers, tokenizer_path, worker_tool
from lodestrata.llm.pretoken import GPT_PATTERN, UnitPool, compile_pattern, encode_by_pattern, space_units
from lodestrata.llm.textops import ragged_index

_NONE = np.iinfo(np.int64).max


class RankTable:
    """Merges of a rank file: pair of ids to the id (which is the rank) of the joined bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        left, right, made, unsafe = [], [], [], set()
        for word, r in rank.items():
            for k in range(1, len(word)):
                a, b = rank.get(word[:k]), rank.get(word[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(r)
                    unsafe.update(t for t in (a, b) if r < t)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.made = keys[order], np.array(made, np.int64)[order]
        self.unsafe = unsafe
        size = max(rank.values()) + 1
        pieces = [b""] * size
        for word, r in rank.items():
            pieces[r] = word
        self.length = np.fromiter(map(len, pieces), np.int64, size)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after another."""
        ids = ids.astype(np.int64)
        return self.bytes[ragged_index(self.first[ids], self.length[ids])]


def replay(table: RankTable, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words one after another, and each word's count, by merge replay over all of them."""
    n = len(symbols)
    sizes = np.diff(np.append(starts, n))
    word = np.repeat(np.arange(len(starts)), sizes)
    sym = symbols.astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[starts + sizes - 1] = -1
    before[starts] = -1
    rank = np.full(n, _NONE)  # of the pair that begins here
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def post(at: np.ndarray) -> None:
        """Index the pairs that begin at these positions."""
        at = at[rank[at] != _NONE]
        if not len(at):
            return
        order = at[np.argsort(rank[at], kind="stable")]
        ranks = rank[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, where in zip(ranks[np.append(0, cut)].tolist(), np.split(order, cut), strict=True):
            if r in index:
                index[r].append(where)
            else:
                index[r] = [where]
                heapq.heappush(queue, r)

    inner = np.flatnonzero(after >= 0)
    rank[inner] = table.rank(sym[inner], sym[inner + 1])
    post(inner)
    while queue:
        r = heapq.heappop(queue)
        at = index.pop(r)
        at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        if r in table.unsafe:
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            if not lead.all():
                index[r] = [at[~lead]]
                heapq.heappush(queue, r)
                at = at[lead]
        else:
            chain = np.append(False, after[at[:-1]] == at[1:])
            if chain.any():
                head = np.maximum.accumulate(np.where(chain, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        sym[at], alive[gone], rank[gone] = r, False, _NONE
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        rank[at] = _NONE
        rank[at[has]] = table.rank(sym[at[has]], sym[beyond[has]])
        left = before[at]
        left = left[left >= 0]
        rank[left] = table.rank(sym[left], sym[after[left]])
        post(np.unique(np.concatenate([at, left])))
    return sym[alive], np.bincount(word[alive], minlength=len(starts))


_PATTERN = compile_pattern(GPT_PATTERN)


def _tools(path: str) -> tuple[RankTable, UnitPool]:
    def make():
        table = RankTable(path)
        return table, UnitPool(encode_by_pattern(_PATTERN, partial(replay, table), table.byte_ids))

    return worker_tool(("codec", path), make)


def encode_block(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's texts, and each text's bounds in them (n + 1)."""
    _, pool = _tools(path)
    starts, ends, first = space_units(raw, offsets, _PATTERN)
    rows = pool.rows(raw, starts, ends)
    total = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(pool.count[rows], out=total[1:])
    return pool.tokens(rows), total[first]


#: Bytes of text whose words are merged together.
REPLAY_BYTES = 4 << 20


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids (array of int): each text's token ids."""
    path = vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in blocks(offsets, REPLAY_BYTES):
                ids, bounds = encode_block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], path)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ids: str = "ids", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id and content (binary): the bytes of each row's ids; null ids give null."""
    path = vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        table, _ = _tools(path)
        for batch in batches:
            out = [None if x is None else table.decode(np.array(x, np.int64)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "content"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, content binary")


def round_trip_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without a shuffle."""
    path = vocabulary or tokenizer_path("byte_bpe_multi_50k.tiktoken")

    def run(batches):
        table, _ = _tools(path)
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in blocks(offsets, REPLAY_BYTES):
                ids, bounds = encode_block(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], path)
                data = memoryview(ids.astype("<u4")).cast("B")
                content = memoryview(table.decode(ids))
                ends_at = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(table.length[ids.astype(np.int64)], out=ends_at[1:])
                at = ends_at[bounds]
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(data[4 * bounds[k] : 4 * bounds[k + 1]]).hexdigest() for k in range(n)], pa.string()),
                        pa.array([hashlib.sha256(content[at[k] : at[k + 1]]).hexdigest() for k in range(n)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
