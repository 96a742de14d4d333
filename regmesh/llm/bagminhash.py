"""BagMinHash signatures of word-shingle multisets, in NumPy.

A document is the multiset of its five-word shingles (of A-Z lower-cased
words); one of one to four words is the single shingle of all its words.

A signature has ``SIZE`` components.  For each shingle and unit of weight
there is a Poisson process of rate 1 for each component; a component is the
first point over all shingles and units, so two documents agree in it with
probability sum(min) / sum(max), the weighted Jaccard similarity, without
bias.  The processes of a shingle are generated jointly over the components
(one process of rate ``SIZE``, each point drawing its component) and
hierarchically over the weights: levels 1, 2, 4, ... cut the weights into
intervals (0, 1], (1, 2], (2, 4], ..., one process per interval; in the
interval that a weight cuts, each point draws its unit and those above the
weight are passed over.  Points come in order of time from hashes of the
shingle, so equal shingles give equal points in every document.

Only points before a time limit matter.  The limit is set so that all
components are nearly always filled by then, about ``SIZE log SIZE`` points
for a document however long; the few documents with a gap are done again
with twice the limit, so signatures are exact.
"""

from __future__ import annotations

import numpy as np

from .textvec import Block, mix, windows

SHINGLE = 5
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
_STEP, _PLACE, _LEVEL = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F),
                         np.uint64(0xE7037ED1A0B428DB))


def shingles(block: Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents, in text order."""
    h, at = windows(block.word_hash, block.word_off, k)
    doc = block.word_doc[at]
    for n in range(1, k):                         # whole texts of fewer words
        short = np.flatnonzero(block.n_words == n)
        if len(short):
            words = block.word_hash[block.word_off[short][:, None] + np.arange(n)]
            off = np.arange(len(short) + 1) * n
            h = np.concatenate([h, windows(words.ravel(), off, n)[0] ^ np.uint64(n)])
            doc = np.concatenate([doc, short])
    return h, doc


def weigh(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) pairs and how often each occurs."""
    key = mix(h + doc.astype(np.uint64) * _STEP)
    order = np.argsort(key)
    h, doc, key = h[order], doc[order], key[order]
    new = np.ones(len(h), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    return h[first], doc[first], np.diff(np.append(first, len(h)))


def _points(h, doc, weight, limit, time, ident, size):
    """Put every point up to ``limit[doc]`` into ``time`` and ``ident`` (documents x components)."""
    seeds, docs, lows, widths, tops = [], [], [], [], []
    low, width = 0, 1
    while True:                                   # intervals (0,1], (1,2], (2,4], ...
        has = weight > low
        if not has.any():
            break
        seeds.append(mix(h[has] + np.uint64((low + 1) * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF)))
        docs.append(doc[has])
        lows.append(np.full(has.sum(), low))
        widths.append(np.full(has.sum(), width))
        tops.append(weight[has])
        low, width = low + width, max(1, low + width)
    seed, d, low, width, top = map(np.concatenate, (seeds, docs, lows, widths, tops))
    x, drawn = np.zeros(len(seed)), 0
    while len(seed):
        k = 1 if len(seed) > 4096 else 32
        r = mix(seed[:, None] + np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * _STEP)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
        steps = np.column_stack([x, gap / (size * width)[:, None]])
        xs = np.cumsum(steps, axis=1)[:, 1:]
        live = xs <= limit[d][:, None]
        row, col = np.nonzero(live)
        point = r[row, col]
        place = mix(point ^ _PLACE)
        unit = (place >> np.uint64(32)) % width[row].astype(np.uint64)
        inside = low[row] + unit.astype(np.int64) < top[row]
        row, col, point, place = row[inside], col[inside], point[inside], place[inside]
        cell = d[row] * size + ((place & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        at = xs[row, col]
        np.minimum.at(time, cell, at)
        won = time[cell] == at
        ident[cell[won]] = point[won]
        more = live[:, -1]
        seed, d, low, width, top, x = (seed[more], d[more], low[more], width[more], top[more],
                                       xs[more, -1])
        drawn += k


def signatures(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int = SIZE) -> np.ndarray:
    """``n_docs`` x ``size`` identities of first points; rows of documents without shingles are 0."""
    ident = np.zeros(n_docs * size, np.uint64)
    if not len(h):
        return ident.reshape(n_docs, size)
    h, doc, weight = weigh(h, doc)
    total = np.bincount(doc, weight, n_docs)
    time = np.full(n_docs * size, np.inf)
    limit = (np.log(size) + 2.5) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        use = todo[doc]
        _points(h[use], doc[use], weight[use], limit, time, ident, size)
        todo &= np.isinf(time.reshape(n_docs, size)).any(1)
        limit = limit * 2
    return ident.reshape(n_docs, size)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per document and band; keys of different bands differ."""
    part = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _LEVEL, (len(sig), bands)).copy()
    for i in range(rows):
        key = mix(key + part[:, :, i])
    return key


def overlap(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, sum(min) and sum(max) of two shingle multisets."""
    ha, da, wa = weigh(*shingles(a))
    hb, db, wb = weigh(*shingles(b))
    step = np.uint64(0x9E3779B97F4A7C15)
    ka, kb = mix(ha + da.astype(np.uint64) * step), mix(hb + db.astype(np.uint64) * step)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(da[ia], np.minimum(wa[ia], wb[ib]), a.n).astype(np.int64)
    total = np.bincount(da, wa, a.n) + np.bincount(db, wb, b.n)
    return both, total.astype(np.int64) - both
