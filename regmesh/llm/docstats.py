"""Statistics of whole documents, from the arrays of ``textvec``."""

from __future__ import annotations

import numpy as np

from .textvec import SPACE, Block, hash_spans, repeated, windows

WINDOW = 8      # words of a repeated passage

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, LETTER, DIGIT, SHOUT = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
DIGIT[48:58] = True
SHOUT[list(b"!?")] = True


def lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    r"""Hash and document of every ``\n``-split line that has a word."""
    new = block.data == 10
    at = np.flatnonzero(new)
    if not len(block.data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cuts = np.unique(np.concatenate([block.off, at, at + 1]))
    first = cuts[:-1]
    lens = np.diff(cuts)
    real = ~new[first]
    first, lens = first[real], lens[real]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    body = block.data[~new]
    filled = np.add.reduceat((~SPACE[body]).astype(np.int64), np.cumsum(lens) - lens) > 0
    doc = np.searchsorted(block.off, first, "right") - 1
    return hash_spans(body, lens)[filled], doc[filled]


def repeat_words(block: Block, k: int = WINDOW) -> np.ndarray:
    """Per document, the words that lie in a ``k``-word window found twice or more in it."""
    h, at = windows(block.word_hash, block.word_off, k)
    twice, _ = repeated(h, block.word_doc[at])
    n, hit = len(block.start) + 1, at[twice]
    cover = np.bincount(hit, minlength=n) - np.bincount(hit + k, minlength=n)
    return block.per_doc_words(np.cumsum(cover[:-1]) > 0)


def base_stats(block: Block, found: tuple | None = None) -> dict[str, np.ndarray]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each document.

    ``found``: what ``lines`` returned, where it has been called already."""
    b = block.data
    line_hash, line_doc = found or lines(block)
    _, extra = repeated(line_hash, line_doc)
    return {
        "n_words": block.n_words,
        "word_chars": block.per_doc(~SPACE[b] & ((b & 0xC0) != 0x80)),
        "n_symbols": block.per_doc(SYMBOL[b]),
        "n_dup_lines": np.bincount(line_doc[extra], minlength=block.n).astype(np.int64),
        "n_repeat_words": repeat_words(block),
    }


FEATURES = ("length", "word_length", "symbols", "capitals", "shouts", "digits", "bare_words",
            "symbol_ends", "stutter", "repeats", "dup_lines", "line_words", "distinct")


def features(block: Block) -> np.ndarray:
    """One row of ``FEATURES`` per document, finite for every text, the empty one included.

    Shares go through the arcsine square root, which evens out their variance;
    counts and lengths through ``log1p``.
    """
    b, n = block.data, block.n_words
    found = lines(block)
    base, line_doc = base_stats(block, found), found[1]
    chars = base["word_chars"]
    n_lines = np.bincount(line_doc, minlength=block.n)
    letters = block.per_doc(LETTER[b])
    start, end, h, doc = block.start, block.end, block.word_hash, block.word_doc
    at = np.flatnonzero(LETTER[b])
    bare = np.searchsorted(at, end) == np.searchsorted(at, start)
    ends = SYMBOL[b[end - 1]] & (end - start > 1)
    stutter = np.zeros(len(h), bool)
    if len(h) > 1:
        stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    _, extra = repeated(h, doc)

    def share(x, of):
        return np.arcsin(np.sqrt(np.clip(x / np.maximum(of, 1), 0.0, 1.0)))

    return np.column_stack([
        np.log1p(n), np.log1p(chars / np.maximum(n, 1)), share(base["n_symbols"], chars),
        share(block.per_doc(UPPER[b]), letters), share(block.per_doc(SHOUT[b]), chars),
        share(block.per_doc(DIGIT[b]), chars), share(block.per_doc_words(bare), n),
        share(block.per_doc_words(ends), n), share(block.per_doc_words(stutter), n),
        share(base["n_repeat_words"], n), share(base["n_dup_lines"], n_lines),
        np.log1p(n / np.maximum(n_lines, 1)), share(n - block.per_doc_words(extra), n),
    ]).astype(np.float64)
