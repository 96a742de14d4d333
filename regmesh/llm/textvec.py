"""Vectorised word work on Arrow text columns.

Texts stay the UTF-8 bytes that Arrow hands over; words, lines and their
64-bit hashes are NumPy arrays over those bytes.  A batch is cut into blocks
of at most ``BLOCK_BYTES`` (one document at least), so a task's memory is a
few dozen times the larger of that bound and its longest document.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)       # a random word per byte value
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), _ODD | np.uint64(1), np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def hash_spans(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive byte spans (``lens`` all positive, summing to ``len(data)``)."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lens) - lens
    at = np.arange(len(data), dtype=np.int64) - np.repeat(first, lens)
    value = _BYTE[data] * _powers(int(lens.max()))[at]
    return mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _M2)


class Block:
    """Consecutive documents as one byte array ``data`` with document offsets ``off``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first_row: int = 0):
        self.data, self.off, self.first_row = data, off, first_row
        self.n = len(off) - 1

    def lower(self) -> "Block":
        """A-Z lower-cased."""
        return Block(LOWER[self.data], self.off, self.first_row)

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    @cached_property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        space = SPACE[self.data]
        before = np.empty(len(space), bool)
        before[1:] = space[:-1]
        inner = self.off[self.off < len(space)]
        before[inner] = True
        after = np.empty(len(space), bool)
        after[:-1] = space[1:]
        after[self.off[self.off > 0] - 1] = True
        return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1

    @property
    def start(self) -> np.ndarray:
        """First byte of each word."""
        return self._edges[0]

    @property
    def end(self) -> np.ndarray:
        return self._edges[1]

    @cached_property
    def word_off(self) -> np.ndarray:
        """Words of document ``d`` are ``word_off[d]:word_off[d + 1]``."""
        return np.searchsorted(self.start, self.off)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_off)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def word_bytes(self) -> np.ndarray:
        """The bytes of all words, white space left out."""
        return self.data[~SPACE[self.data]]

    @cached_property
    def word_hash(self) -> np.ndarray:
        return hash_spans(self.word_bytes, self.end - self.start)

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Per document, how many of its bytes are flagged."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.off))

    def per_doc_words(self, flags: np.ndarray) -> np.ndarray:
        """Per document, how many of its words are flagged."""
        return np.diff(np.searchsorted(np.flatnonzero(flags), self.word_off))

    def text(self, d: int) -> str:
        return self.data[self.off[d]:self.off[d + 1]].tobytes().decode("utf-8", "replace")


def windows(hashes: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-windows inside each group ``off[g]:off[g + 1]``, and where they begin."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(hashes) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + hashes[i:i + n]) * _M1
        h ^= h >> np.uint64(29)
    sizes = np.diff(off)
    last = np.repeat(off[1:], sizes)                         # end of the group of each element
    at = np.flatnonzero(np.arange(n) + k <= last[:n])
    return mix(h[at]), at


def repeated(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal (group, value) pairs that occur twice or more: a flag on each, and one on all but one."""
    twice, extra = np.zeros(len(values), bool), np.zeros(len(values), bool)
    if len(values) > 1:
        key = mix(values + group.astype(np.uint64) * _ODD)
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        extra[order[1:]] = same
        twice[order[1:]] = same
        twice[order[:-1]] |= same
    return twice, extra


def as_text(column: pa.Array) -> pa.Array:
    """A text column without nulls."""
    if pa.types.is_null(column.type):
        return pa.array([""] * len(column), pa.string())
    return pc.fill_null(column, "")


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column in blocks of at most ``max_bytes`` (one document at least)."""
    column = as_text(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, "right")) - 1)
        to = min(to, len(column))
        yield Block(raw[off[at]:off[to]], off[at:to + 1] - off[at], at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def null_mask(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.is_null(column(batch, name)).to_numpy(zero_copy_only=False)


class SpanTable:
    """Integer arrays by span hash, in a hash table of fixed size that outlives a block.

    A later span takes the slot of an earlier one, so memory stays bounded by
    ``slots`` and ``keep`` (stored values after which the table starts anew)
    and only spans that are not there are worked out again.
    """

    def __init__(self, slots: int = 1 << 21, keep: int = 8_000_000):
        self.slots, self.keep = slots, keep
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int32)
        self.len = np.zeros(self.slots, np.int32)
        self.values = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _store(self, keys: np.ndarray, lens: np.ndarray, values: np.ndarray) -> None:
        if self.used + len(values) > len(self.values):
            self.values = np.concatenate([self.values[:self.used],
                                          np.zeros(max(len(self.values), len(values)), np.uint32)])
        self.values[self.used:self.used + len(values)] = values
        slot = (keys % np.uint64(self.slots)).astype(np.int64)
        self.key[slot] = keys
        self.at[slot] = self.used + np.cumsum(lens) - lens
        self.len[slot] = lens
        self.used += len(values)

    def look_up(self, keys: np.ndarray, work) -> tuple[np.ndarray, np.ndarray]:
        """All spans' values in a row and how many each has.

        ``work(first)`` gives (lengths, values) of the spans at the positions ``first``."""
        if self.used > self.keep:
            self.clear()
        slot = (keys % np.uint64(self.slots)).astype(np.int64)
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        while len(todo):                # spans of one block that share a slot take turns
            missing = todo[self.key[slot[todo]] != keys[todo]]
            if len(missing):
                _, first = np.unique(keys[missing], return_index=True)
                first = missing[first]
                _, one = np.unique(slot[first], return_index=True)
                first = first[one]
                self._store(keys[first], *work(first))
            hit = self.key[slot[todo]] == keys[todo]
            done = todo[hit]
            at[done], size[done] = self.at[slot[done]], self.len[slot[done]]
            todo = todo[~hit]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.arange(total) + np.repeat(at - (ends - size), size)], size
