"""FM-index over short passages of integer symbols, on NumPy arrays.

The text is a run of passages, each ended by symbol 0.  Every separator counts
as a symbol of its own (ordered by place), so suffixes differ at the end of
their passage at the latest: sorting by prefix doubling takes as many rounds
as the logarithm of a passage, however long the copies in a corpus are, and a
round sorts only the suffixes that are still tied.

The Burrows-Wheeler transform lies in a wavelet matrix (one bit row per bit of
a symbol, packed, with a running count for each 64 bits).  ``search`` narrows
the row ranges of many phrases at once, last symbol first; ``locate`` walks
rows back to the nearest sampled suffix position, ``SAMPLE`` steps at most.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols`` (int64, 0 = separator, each one unique)."""
    n = len(symbols)
    sep = symbols == 0
    n_sep = int(sep.sum())
    rank = symbols + n_sep
    rank[sep] = np.arange(n_sep)
    bits = int(n_sep + symbols.max(initial=0) + 1).bit_length()
    h = 3 if bits <= 21 else 2
    key = rank.copy()
    for i in range(1, h):
        key <<= bits
        key[:n - i] |= rank[i:]
    order = np.argsort(key)
    key = key[order]
    rows = np.arange(n)
    members = order
    while True:
        first = np.ones(len(rows), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        start = np.maximum.accumulate(np.where(first, rows, 0))
        rank[members] = start
        alone = first.copy()
        alone[:-1] &= first[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        rows, members = rows[tied], members[tied]
        key = start[tied] * n + rank[members + h]       # a tied suffix has h symbols before its end
        by = np.argsort(key)
        key, members = key[by], members[by]
        order[rows] = members
        h *= 2


class FMIndex:
    """Index of ``symbols``: passages of positive symbols, each ended by a 0."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.asarray(symbols, np.int64)
        n = self.n = len(symbols)
        order = suffix_array(symbols)
        bwt = symbols[order - 1]
        counts = np.bincount(symbols, minlength=1)
        self.less = np.concatenate([[0], np.cumsum(counts)])       # symbols below each symbol
        self.depth = max(int(len(counts) - 1).bit_length(), 1)
        self._build(bwt.astype(np.int32))
        start = np.concatenate([[0], np.flatnonzero(symbols[:-1] == 0) + 1]) if n else np.zeros(0, int)
        lens = np.diff(np.append(start, n))
        sampled = (np.arange(n) - np.repeat(start, lens)) % SAMPLE == 0
        marked = sampled[order]
        self.marks, self.mark_sums = _packed(marked)
        self.samples = order[marked].astype(np.int32 if n < 1 << 31 else np.int64)

    def _build(self, level: np.ndarray) -> None:
        self.bits, self.sums, self.zeros = [], [], []
        for d in range(self.depth - 1, -1, -1):
            one = (level >> d & 1).astype(bool)
            words, sums = _packed(one)
            self.bits.append(words)
            self.sums.append(sums)
            level = np.concatenate([level[~one], level[one]])
            self.zeros.append(self.n - int(one.sum()))
        self.base = np.zeros(len(self.less) - 1, np.int64)         # where a symbol's leaf begins
        if self.n:
            first = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            self.base[level[first]] = first

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before the given row."""
        at = row
        for d, words, sums, zeros in zip(range(self.depth - 1, -1, -1), self.bits, self.sums, self.zeros):
            ones = _ones(words, sums, at)
            at = np.where(symbol >> d & 1, zeros + ones, at - ones)
        return at - self.base[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one symbol longer to the left."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for words, sums, zeros in zip(self.bits, self.sums, self.zeros):
            one = _bit(words, at)
            ones = _ones(words, sums, at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return self.less[symbol] + at - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges ``[low, high)`` of the suffixes that begin with each row of ``phrases``
        (one length, symbols positive; a symbol that the text lacks gives an empty range)."""
        k, width = phrases.shape
        low, high = np.zeros(k, np.int64), np.zeros(k, np.int64)
        live = np.flatnonzero((phrases < len(self.base)).all(axis=1) & (phrases > 0).all(axis=1))
        last = phrases[live, width - 1]
        a, b = self.less[last], self.less[last + 1]
        for j in range(width - 2, -1, -1):
            some = a < b
            live, a, b = live[some], a[some], b[some]
            if not len(live):
                break
            s = phrases[live, j]
            both = self.rank(np.concatenate([s, s]), np.concatenate([a, b]))
            a, b = self.less[s] + both[:len(s)], self.less[s] + both[len(s):]
        low[live], high[live] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows`` (none may begin with a separator)."""
        found = np.zeros(len(rows), np.int64)
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        step = 0
        while len(left):
            known = _bit(self.marks, at).astype(bool)
            hit = at[known]
            found[left[known]] = self.samples[_ones(self.marks, self.mark_sums, hit)] + step
            left, at = left[~known], self.back(at[~known])
            step += 1
        return found


def _packed(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags as 64-bit words (one spare word at the end), and the ones before each word."""
    raw = np.zeros((len(flags) // 64 + 1) * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    raw[:len(packed)] = packed
    words = raw.view(np.uint64)
    sums = np.zeros(len(words), np.int32)
    np.cumsum(np.bitwise_count(words[:-1]), out=sums[1:])
    return words, sums


def _ones(words: np.ndarray, sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    word = at >> 6
    below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return sums[word] + np.bitwise_count(words[word] & below)


def _bit(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
