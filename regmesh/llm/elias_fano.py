"""Elias-Fano sequences and the word n-gram trie built from them, on memory-mapped arrays.

``EliasFano`` keeps a non-decreasing sequence in about 2 + log2(u / n) bits a
value: the low bits packed, the high bits in unary.  All access is vectorised:
the first search lays out where the ones and zeros of the unary bits are, so
selecting one is an index.  ``find`` is a successor search within a given
range: the unary bits give the few elements that share the value's high part,
halving decides among those that lie in the range.

``Trie`` holds n-grams of word ids by their context, first word on top.  A
node's symbol is stored relative to its parent (ids * parent + word, which is
increasing), pointers are the running counts of children; both are
Elias-Fano sequences.  Each last node carries a code of its discounted share
of the context, log10 (n - D) / total, and each context one of the weight
that it leaves to the order below, log10 D kinds / total, both quantised to
256 values.  ``look_up`` descends all queries at once, finding a word by
successor search within its context's range.
"""

from __future__ import annotations

import io
import tempfile
from dataclasses import dataclass
from functools import cached_property

import numpy as np

_ONE = np.uint64(1)


def _pack(bits: np.ndarray) -> np.ndarray:
    """0/1 bytes to 64-bit words, lowest bit first, with one spare word at the end."""
    raw = np.packbits(bits, bitorder="little")
    return np.frombuffer(raw.tobytes() + b"\0" * (16 - len(raw) % 8), np.uint64)


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray         # packed low bits
    high: np.ndarray        # unary high parts
    top: int                # high part of the last value

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            part = values & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n) * low_bits
            at, shift = bit >> 6, (bit & 63).astype(np.uint64)
            word, first = np.unique(at, return_index=True)
            low[word] = np.add.reduceat(part << shift, first)       # no two share a bit
            spill = np.flatnonzero(shift + np.uint64(low_bits) > 64)
            low[at[spill] + 1] += part[spill] >> (np.uint64(64) - shift[spill])
        high = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, low, _pack(high), top >> low_bits)

    def _where(self, bit: int) -> np.ndarray:
        """Positions of the ones or zeros of ``high``."""
        bits = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little")
        at = np.flatnonzero(bits == bit)
        return at.astype(np.int32) if len(bits) < 1 << 31 else at

    @cached_property
    def _ones(self) -> np.ndarray:
        return self._where(1)

    @cached_property
    def _zeros(self) -> np.ndarray:
        return self._where(0)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        value = (self._ones[i] - i).astype(np.uint64)
        if self.low_bits:
            bit = i * self.low_bits
            at, shift = bit >> 6, (bit & 63).astype(np.uint64)
            low = (self.low[at] >> shift) | (self.low[at + 1] << (np.uint64(63) - shift) << _ONE)
            value = (value << np.uint64(self.low_bits)) | (low & np.uint64((1 << self.low_bits) - 1))
        return value.astype(np.int64)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Ones of ``high`` before its ``k``-th zero: elements whose high part is at most ``k``."""
        return self._zeros[k] - k

    def find(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """A position of ``value`` within the range ``lo:hi``, or -1: successor search."""
        out = np.full(len(lo), -1, np.int64)
        if not self.n:
            return out
        part = value >> self.low_bits
        hi = np.where(part <= self.top, hi, lo)             # beyond the last value
        part = np.minimum(part, self.top)
        lo = np.maximum(lo, np.where(part > 0, self._zero(np.maximum(part - 1, 0)), 0))
        hi = np.minimum(hi, self._zero(part))
        todo = np.flatnonzero(lo < hi)
        lo, hi, value = lo[todo], hi[todo], value[todo]
        while len(todo):
            mid = (lo + hi) >> 1
            got = self.get(mid)
            hit = got == value
            out[todo[hit]] = mid[hit]
            less = got < value
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            rest = np.flatnonzero(~hit & (lo < hi))
            todo, lo, hi, value = todo[rest], lo[rest], hi[rest], value[rest]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, self.top], np.int64), self.low, self.high]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> "EliasFano":
        head, low, high = arrays
        return cls(int(head[0]), int(head[1]), np.asarray(low), np.asarray(high), int(head[2]))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and their 256 values: all values if there are no more, or the means of bins
    of equal width, so no value is off by more than a 256th of their range."""
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(256, np.float32)
    u = np.unique(x)
    if len(u) <= 256:
        return np.searchsorted(u, x).astype(np.uint8), np.resize(u, 256).astype(np.float32)
    code = np.minimum((x - u[0]) * (256 / (u[-1] - u[0])), 255).astype(np.uint8)
    n = np.bincount(code, minlength=256)
    return code, (np.bincount(code, x, 256) / np.maximum(n, 1)).astype(np.float32)


def save(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    out.write(np.array([len(arrays)], np.int64).tobytes())
    for a in arrays:
        kind = np.frombuffer(a.dtype.str.encode().ljust(8), np.uint8)
        out.write(kind.tobytes() + np.array([len(a)], np.int64).tobytes())
        raw = a.tobytes()
        out.write(raw + b"\0" * (-len(raw) % 8))
    return out.getvalue()


def load(blob: bytes, mapped: bool = True) -> list[np.ndarray]:
    """The arrays of ``save``; if ``mapped``, from an unnamed file in the task's temporary folder."""
    if mapped:
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
    else:
        raw = np.frombuffer(blob, np.uint8)
    out, at = [], 8
    for _ in range(int(raw[:8].view(np.int64)[0])):
        kind = np.dtype(raw[at:at + 8].tobytes().decode().strip())
        n = int(raw[at + 8:at + 16].view(np.int64)[0])
        at += 16
        size = n * kind.itemsize
        out.append(raw[at:at + size].view(kind))
        at += size + -size % 8
    return out


MISSING = 256               # code of an n-gram or context that is not there


@dataclass
class Trie:
    ids: int                    # word ids are below this
    symbols: list[EliasFano]    # of each depth: ids * parent + word of its nodes
    starts: list[EliasFano]     # of each depth but the last: children before each node
    share: np.ndarray           # code of each last node
    share_values: np.ndarray
    weight: np.ndarray          # code of each context
    weight_values: np.ndarray

    @classmethod
    def build(cls, words: list[np.ndarray], count: np.ndarray, ids: int, discount: float) -> "Trie":
        """From distinct n-grams in order, a column of ids per place, and how often each occurs."""
        n = len(count)
        symbols, starts = [], []
        new, parent, above = np.arange(n) == 0, np.zeros(n, np.int64), 1
        for d, w in enumerate(words):
            new = new | (np.diff(w, prepend=-1) != 0)
            at = np.flatnonzero(new)
            if d:
                kids = np.bincount(parent[at], minlength=above)
                starts.append(EliasFano.build(np.concatenate([[0], np.cumsum(kids)])))
            symbols.append(EliasFano.build(parent[at] * ids + w[at]))
            if d == len(words) - 2:
                context = np.cumsum(new) - 1
            parent, above = np.cumsum(new) - 1, len(at)
        total, kinds = np.bincount(context, count), np.bincount(context)
        share = quantise(np.log10((count - discount) / total[context]))
        weight = quantise(np.log10(discount * kinds / total))
        return cls(ids, symbols, starts, *share, *weight)

    def to_bytes(self) -> bytes:
        head = np.array([self.ids, len(self.symbols)], np.int64)
        return save([head, *[a for ef in self.symbols + self.starts for a in ef.arrays()],
                     self.share, self.share_values, self.weight, self.weight_values])

    @classmethod
    def from_bytes(cls, blob: bytes) -> "Trie":
        a = load(blob)
        ids, depth = int(a[0][0]), int(a[0][1])
        ef = [EliasFano.of(a[1 + 3 * k:4 + 3 * k]) for k in range(2 * depth - 1)]
        return cls(ids, ef[:depth], ef[depth:], *a[-4:])

    def look_up(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the shares of n-grams (sorted, a column per place) and of their contexts' weights."""
        n = len(words[0])
        weight = np.full(n, MISSING, np.uint16)
        new, at = np.arange(n) == 0, np.zeros(1, np.int64)
        up = np.zeros(n, np.int64)              # which distinct prefix each n-gram has
        for d, w in enumerate(words):
            new = new | (np.diff(w, prepend=-1) != 0)
            first = np.flatnonzero(new)         # each prefix is looked for once
            node = at[up[first]]
            known = np.flatnonzero(node >= 0)
            node, word = node[known], w[first][known]
            lo, hi = ((self.starts[d - 1].get(node), self.starts[d - 1].get(node + 1)) if d else
                      (np.zeros(len(node), np.int64), np.full(len(node), self.symbols[0].n)))
            at = np.full(len(first), -1, np.int64)
            at[known] = self.symbols[d].find(lo, hi, node * self.ids + word)
            up = np.cumsum(new) - 1
            if d == len(words) - 2:
                weight = _codes(self.weight, at)[up]
        return _codes(self.share, at)[up], weight


def _codes(stored: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.full(len(at), MISSING, np.uint16)
    out[at >= 0] = stored[at[at >= 0]]
    return out
