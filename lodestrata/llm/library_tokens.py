"""Token ids as the tokenizers library gives them for ``word_bpe_49k.json``, block by block.

The vocabulary lower-cases, drops white space and cuts words into runs of
letters, single digits and runs of other characters before its merges. Words of
ASCII and Latin-1 letters are cut and lowered that way with numpy, and the
library's own model encodes each distinct piece once. Words with any other
character, an apostrophe (contractions) or a special token's name go whole
through the library's full tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from lodestrata.llm.common import blocks, text_buffers, worker_tool
from lodestrata.llm.pretoken import DIGIT, WHOLE, UnitPool, classes
from lodestrata.llm.textops import ragged_index, words

END_ID = 1

_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The published byte-to-letter table of byte-level BPE: printable Latin-1 stands for itself."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with plain words lowered, and the pieces' starts, ends and first piece by document (n + 1)."""
    kind = classes(raw)
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    starts, ends, _ = words(raw, offsets)
    if not len(starts):
        return raw, starts, ends, np.zeros(len(offsets), np.int64)
    odd = kind == WHOLE
    odd[:-1] |= (raw[:-1] == 60) & (raw[1:] == 124)  # "<|": a special token's name may follow
    total = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(odd, out=total[1:])
    whole = total[ends] > total[starts]
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    low[after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 32
    begin = np.zeros(len(raw), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begin[starts] = True
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    begin &= np.cumsum(inside[:-1], dtype=np.int8) > 0
    if whole.any():
        at = ragged_index(starts[whole], (ends - starts)[whole])
        low[at] = raw[at]
        begin[at] = False
        begin[starts[whole]] = True
    first = np.flatnonzero(begin)
    last = np.minimum(np.append(first[1:], len(raw)), ends[np.searchsorted(starts, first, "right") - 1])
    return low, first, last, np.searchsorted(first, offsets)


def _make_pool(path: str) -> UnitPool:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, table = tokenizer.model, str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for u in units:
            if _PLAIN.fullmatch(u):
                ids = [t.id for t in model.tokenize(u.decode("latin-1").translate(table))]
            else:
                ids = tokenizer.encode(u.decode("utf-8", "replace"), add_special_tokens=False).ids
            flat += ids
            sizes.append(len(ids))
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    return UnitPool(encode)


def _pool(path: str) -> UnitPool:
    """One bounded pool for each worker process."""
    return worker_tool(("library", path), lambda: _make_pool(path))


def encode_column(column: pa.Array, path: str):
    """Yields ``(i, j, ids, bounds)`` for blocks of rows: row ``i + k`` has ``ids[bounds[k]:bounds[k + 1]]``, the end id last."""
    pool = _pool(path)
    raw, offsets = text_buffers(column)
    for i, j in blocks(offsets):
        own, starts, ends, first = pieces(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rows = pool.rows(own, starts, ends)
        total = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(pool.count[rows], out=total[1:])
        sizes = total[first[1:]] - total[first[:-1]]
        bounds = np.zeros(j - i + 1, np.int64)
        np.cumsum(sizes + 1, out=bounds[1:])
        ids = np.full(int(bounds[-1]), END_ID, np.uint32)
        body = np.ones(len(ids), bool)
        body[bounds[1:] - 1] = False
        ids[body] = pool.tokens(rows)
        yield i, j, ids, bounds
