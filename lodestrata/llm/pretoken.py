"""Distinct-unit encoding: a text's tokens are looked up by unit, and each unit is encoded once.

A unit is a stretch of text whose tokens depend on nothing around it. Texts are
cut into units with numpy, the distinct units of a block are found by hash, and
only those not yet in a bounded pool are handed to an encoder.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex

from lodestrata.llm.textops import IS_SPACE, hash_spans, ragged_index, same_spans, sums_by_range

#: Fixed value: the published pattern that cuts text before the merges of byte-level BPE.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters of Unicode's White_Space, which the tokenizer libraries mean by \s.
WHITE_SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"

_MAYBE_SPACE_END = IS_SPACE.copy()
_MAYBE_SPACE_END[[*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_MAYBE_SPACE_START = IS_SPACE.copy()
_MAYBE_SPACE_START[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def compile_pattern(pattern: str) -> regex.Pattern:
    """``pattern`` with \\s and \\S spelt out, as this library's own \\s takes a few control characters more."""
    return regex.compile(pattern.replace(r"[^\s\p{L}", rf"[^{WHITE_SPACE}\p{{L}}").replace(r"\s", f"[{WHITE_SPACE}]").replace(r"\S", f"[^{WHITE_SPACE}]"))


LETTER, DIGIT, OTHER, SPACE, WHOLE = 1, 2, 3, 4, 5
_CLASS = np.full(256, WHOLE, np.uint8)
_CLASS[33:127] = OTHER
_CLASS[[*range(65, 91), *range(97, 123), 0xC3]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[39] = WHOLE
_CLASS[IS_SPACE] = SPACE
#: A unit that is a pre-token as it stands.
_PLAIN = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


def classes(raw: np.ndarray) -> np.ndarray:
    """Class of each byte: ASCII and Latin-1 letters, ASCII digits, other printable ASCII, white space.

    Apostrophes, control characters and all other characters are WHOLE: what
    holds one is left to the pattern or to the library.
    """
    kind = _CLASS[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    # The second byte of a Latin-1 letter, but for the multiplication and division signs.
    kind[after & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)] = LETTER
    return kind


def _cut_plain(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut units of letters, digits and other printable ASCII into their pre-tokens; leave the others whole."""
    kind = classes(raw)
    lead = raw[starts] == 32
    bad = (kind == WHOLE) | (kind == SPACE)
    total = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(bad, out=total[1:])
    plain = total[ends] - total[starts] == lead
    begin = np.zeros(len(raw), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[starts[plain & lead] + 1 - (ends == starts + 1)[plain & lead]] = False
    if not plain.all():
        begin[ragged_index(starts[~plain], (ends - starts)[~plain])] = False
    begin[starts] = True
    cut = np.flatnonzero(begin)
    last = np.append(cut[1:], len(raw))
    return cut, last, np.searchsorted(cut, np.append(starts, len(raw))[doc_first])


def encode_by_pattern(pattern: regex.Pattern, merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], byte_ids: np.ndarray) -> Callable:
    """An encoder for :class:`UnitPool`: units to pre-tokens by ``pattern``, distinct pre-tokens to ids by ``merge``."""

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        parts, sizes = [], []
        for u in units:
            if _PLAIN.fullmatch(u):
                parts.append(number.setdefault(u, len(number)))
                sizes.append(1)
            else:
                found = [p.encode() for p in pattern.findall(u.decode("utf-8", "replace"))]
                parts += [number.setdefault(p, len(number)) for p in found]
                sizes.append(len(found))
        if not number:
            return np.zeros(0, np.uint32), np.zeros(len(units), np.int64)
        length = np.fromiter(map(len, number), np.int64, len(number))
        flat, count = merge(byte_ids[np.frombuffer(b"".join(number), np.uint8)], np.cumsum(length) - length)
        parts = np.array(parts, np.int64)
        bounds = np.append(0, np.cumsum(sizes))
        return flat[ragged_index((np.cumsum(count) - count)[parts], count[parts])], sums_by_range(count[parts], bounds)

    return encode


def space_units(raw: np.ndarray, offsets: np.ndarray, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units for :data:`GPT_PATTERN`: each space begins one, and plain ones are cut into pre-tokens.

    Returns starts, ends and each document's first unit (n + 1).

    Cutting before every space changes nothing unless white space stands on both
    sides of a space, or before a space that ends the text. Documents where that
    may be so are cut by the pattern itself.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin = raw == 32
    before = np.zeros(n, bool)
    before[1:] = _MAYBE_SPACE_END[raw[:-1]]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after = np.zeros(n, bool)
    after[:-1] = _MAYBE_SPACE_START[raw[1:]]
    after[offsets[1:][full] - 1] = True
    odd = np.unique(np.searchsorted(offsets, np.flatnonzero(begin & before & after), "right") - 1)
    begin[offsets[:-1][full]] = True
    data = raw.tobytes() if len(odd) else b""
    for d in odd.tolist():
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        begin[lo:hi] = False
        pieces = pattern.findall(data[lo:hi].decode("utf-8", "replace"))
        at = lo + np.cumsum([0, *(len(p.encode()) for p in pieces[:-1])])
        if pieces:
            begin[at[at < hi]] = True
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    return _cut_plain(raw, starts, np.append(starts[1:], n), first)


class UnitPool:
    """Token ids of units met so far, in flat arrays; one that outgrows ``limit`` units keeps those of the block at hand.

    ``encode`` maps a list of distinct byte strings to their ids, one after another, and their counts.
    Rows of one block stay valid until the next call of :meth:`rows`.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _add(self, units: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.at)
        for k in ("first", "count"):
            have = getattr(self, k)
            if n + len(units) > len(have):
                setattr(self, k, np.concatenate([have, np.zeros(n + len(units), np.int64)]))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.count[n : n + len(units)] = sizes
        self.first[n : n + len(units)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.at.update(zip(units, range(n, n + len(units)), strict=True))

    def rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each span in ``first`` and ``count``; spans of one hash are compared byte by byte."""
        if not len(starts):
            return np.zeros(0, np.int64)
        _, at, inverse = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        size = ends - starts
        other = size != size[at][inverse]
        other |= ~same_spans(raw, starts, starts[at][inverse], np.where(other, 0, size))
        if other.any():  # one hash for different bytes: such spans stand for themselves
            own = np.flatnonzero(other)
            inverse[own] = len(at) + np.arange(len(own))
            at = np.concatenate([at, own])
        data = raw.tobytes()
        units = [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        found = [self.at.get(u, -1) for u in units]
        if missing := list(dict.fromkeys(u for u, k in zip(units, found, strict=True) if k < 0)):
            if len(self.at) + len(missing) > self.limit:
                known = {u: k for u, k in zip(units, found, strict=True) if k >= 0}
                own = np.fromiter(known.values(), np.int64, len(known))
                flat, sizes = self.tokens(own), self.count[own]
                self._clear()
                self._add(list(known), flat, sizes)
            self._add(missing, *self.encode(missing))
            found = [self.at[u] for u in units]
        return np.array(found, np.int64)[inverse]

    def tokens(self, rows: np.ndarray) -> np.ndarray:
        """Ids of all rows, one after another."""
        return self.ids[ragged_index(self.first[rows], self.count[rows])]
