"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

Texts are prepared as the model asks: a leading space, spaces as the mark
``\\u2581`` (a space byte here).  No piece has the mark after another
character, so a text splits into chunks, marks followed by other characters,
that are encoded on their own; chunks met before are looked up.  For the new
chunks of a block:

1. their texts are concatenated and indexed by a suffix array (sorted by as
   many bytes as the longest piece has);
2. every piece of the model is binary-searched for its range of occurrences,
   all pieces at once;
3. the occurrences are the edges of a lattice, sorted by position;
4. relaxation in the model's order: in each chunk the joint edge over two
   neighbouring nodes with the best score, the leftmost of equals, replaces
   them, until no edge joins two neighbours.  All chunks advance together;
   chunks of over ``LONG`` characters use a heap instead.

What no piece covers is encoded byte by byte.  Ids equal the library's.
Decoding joins the pieces and bytes and drops the leading space, so a text
comes back up to the mark itself, which is read as a space.

Defined results: a null or empty text has no ids and decodes to the empty
text; null and repeated rows and any ``doc_id`` are encoded one by one; an
empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table
from .textvec import Block, SpanTable, as_text, blocks, column, hash_spans

MODEL = "piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6         # piece types of the model file (fixed values)
LONG = 256
BLOCK_BYTES = 1 << 20


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


class Pieces:
    """A model's pieces as byte strings (the mark as a space), scores and ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        if (spec.model_type != 2 or not spec.byte_fallback or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or norm.precompiled_charsmap):
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        plain = [(i, p.piece.replace(MARK, " ").encode(), p.score)
                 for i, p in enumerate(proto.pieces) if p.type == NORMAL]
        if any(b" " in b.lstrip(b" ") for _, b, _ in plain):
            raise ValueError("the model has pieces that go on past a space")
        self.ids = np.array([i for i, _, _ in plain], np.int64)
        self.bytes = [b for _, b, _ in plain]
        self.scores = np.array([s for _, _, s in plain])
        self.byte_id = np.zeros(256, np.int64)
        self.text = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_id[value] = i
                self.text[i] = bytes([value])
        for i, b, _ in plain:
            self.text[i] = b
        self.lens = np.array([len(b) for b in self.bytes])
        self.words = -(-int(self.lens.max()) // 8)          # 8-byte words of a suffix key
        size = 8 * self.words
        self.low = _keys(b"".join(b.ljust(size, b"\0") for b in self.bytes), self.words)
        self.high = _keys(b"".join(b.ljust(size, b"\xff") for b in self.bytes), self.words)


def _keys(raw: bytes, words: int) -> list[np.ndarray]:
    """Big-endian words of equally long byte strings, first word first."""
    return [c.astype(np.uint64) for c in np.frombuffer(raw, ">u8").reshape(-1, words).T]


def suffix_array(data: np.ndarray, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of the next ``8 * words`` bytes, and those bytes as sorted words."""
    padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
    word = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | padded[i:i + len(word)]
    keys = [word[8 * k:8 * k + len(data)] for k in range(words)]
    order = np.lexsort(keys[::-1])
    return order, [k[order] for k in keys]


def _bound(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
    """For each wanted key, how many sorted keys are smaller (or, ``after``, not greater)."""
    lo = np.zeros(len(wanted[0]), np.int64)
    hi = np.full(len(lo), len(keys[0]))
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(keys[0]) - 1)
        less = np.zeros(len(lo), bool)
        equal = np.ones(len(lo), bool)
        for k, w in zip(keys, wanted):
            here = k[mid]
            less |= equal & (here < w)
            equal &= here == w
        go = open_ & (less | (equal if after else False))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)
    return lo


class Lattice:
    """All occurrences of pieces in a text, as edges sorted by position and length."""

    def __init__(self, data: np.ndarray, pieces: Pieces):
        order, keys = suffix_array(data, pieces.words)
        first, last = _bound(keys, pieces.low, False), _bound(keys, pieces.high, True)
        n = last - first
        at = order[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
        piece = np.repeat(np.arange(len(n)), n)
        self.stride = int(pieces.lens.max()) + 1
        key = at * self.stride + pieces.lens[piece]
        by_position = np.argsort(key)
        self.key, self.piece = key[by_position], piece[by_position]

    def join(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece over each span, or -1."""
        size = end - start
        want = start * self.stride + size
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        if not len(self.key):
            return np.full(len(start), -1)
        return np.where((size < self.stride) & (self.key[at] == want), self.piece[at], -1)


def _relax(start, end, chunk, lattice: Lattice, scores: np.ndarray):
    """Merge neighbours, one edge per chunk and round; the final nodes' (start, end)."""
    done = []
    score = np.append(scores, -np.inf)          # of piece -1
    best = np.full(len(start), -np.inf)         # score of joining a node with the next one
    if len(start) > 1:
        same = np.flatnonzero(chunk[1:] == chunk[:-1])
        best[same] = score[lattice.join(start[same], end[same + 1])]
    while len(start):
        first = np.flatnonzero(np.diff(chunk, prepend=-1))
        top = np.maximum.reduceat(best, first)
        size = np.diff(np.append(first, len(start)))
        live = np.repeat(top > -np.inf, size)
        done.append((start[~live], end[~live]))
        start, end, chunk, best = start[live], end[live], chunk[live], best[live]
        if not len(start):
            break
        hit = np.flatnonzero(best == np.repeat(top[top > -np.inf], size[top > -np.inf]))
        merge = hit[np.diff(chunk[hit], prepend=-1) != 0]       # the leftmost of each chunk
        end[merge] = end[merge + 1]
        keep = np.ones(len(start), bool)
        keep[merge + 1] = False
        at = merge - np.arange(len(merge))                      # places after the removal
        start, end, chunk, best = start[keep], end[keep], chunk[keep], best[keep]
        again = np.unique(np.concatenate([at, at[at > 0] - 1]))
        best[again] = -np.inf
        again = again[again + 1 < len(start)]
        again = again[chunk[again] == chunk[again + 1]]
        best[again] = score[lattice.join(start[again], end[again + 1])]
    return (np.concatenate([s for s, _ in done] or [start]), np.concatenate([e for _, e in done] or [end]))


def _relax_long(start: np.ndarray, end: np.ndarray, lattice: Lattice, scores: np.ndarray):
    """The same for one long chunk, with a heap."""
    start, end = start.tolist(), end.tolist()
    before, after = list(range(-1, len(start) - 1)), [*range(1, len(start)), -1]
    lo, hi = np.searchsorted(lattice.key, [start[0] * lattice.stride, (end[-1] + 1) * lattice.stride])
    edges = dict(zip(lattice.key[lo:hi].tolist(), lattice.piece[lo:hi].tolist()))
    heap: list = []

    def push(i: int) -> None:
        j = after[i] if i >= 0 else -1
        if j >= 0 and end[j] - start[i] < lattice.stride:
            piece = edges.get(start[i] * lattice.stride + end[j] - start[i])
            if piece is not None:
                heapq.heappush(heap, (-scores[piece], start[i], i, j, end[j]))
    for i in range(len(start)):
        push(i)
    alive = [True] * len(start)
    while heap:
        _, _, i, j, e = heapq.heappop(heap)
        if not alive[i] or not alive[j] or after[i] != j or end[j] != e:
            continue
        end[i], alive[j], after[i] = e, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        push(i)
        push(before[i])
    keep = np.array(alive)
    return np.array(start)[keep], np.array(end)[keep]


class Encoder:
    """Encoder and decoder of one model; the table of known chunks outlives a task."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known = SpanTable()
        self.flat = np.frombuffer(b"".join(self.pieces.text), np.uint8)
        self.flat_len = np.array([len(b) for b in self.pieces.text])
        self.flat_at = np.cumsum(self.flat_len) - self.flat_len

    def chunk_ids(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk, and all ids."""
        zero = np.zeros(1, np.uint8)
        data = np.concatenate([x for t in texts for x in (t, zero)])
        lens = np.array([len(t) for t in texts])
        begin = np.cumsum(lens + 1) - lens - 1
        lattice = Lattice(data, self.pieces)
        # nodes: the characters
        lead = (data & 0xC0) != 0x80
        lead[begin + lens] = False                              # the separators
        start = np.flatnonzero(lead)
        chunk = np.searchsorted(begin, start, "right") - 1
        end = np.append(start[1:], len(data))
        end = np.minimum(end, begin[chunk] + lens[chunk])
        big = np.bincount(chunk, minlength=len(texts)) > LONG
        long_ = big[chunk]
        parts = [_relax(start[~long_], end[~long_], chunk[~long_], lattice, self.pieces.scores)]
        for c in np.flatnonzero(big):
            mine = chunk == c
            parts.append(_relax_long(start[mine], end[mine], lattice, self.pieces.scores))
        start, end = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(start)
        start, end = start[order], end[order]
        piece = lattice.join(start, end)
        covered = piece >= 0
        size = np.where(covered, 1, end - start)                # ids of each node
        first = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int64)
        ids[first[covered]] = self.pieces.ids[piece[covered]]
        lost = np.flatnonzero(~covered)
        n = size[lost]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids[np.repeat(first[lost], n) + inner] = self.pieces.byte_id[data[np.repeat(start[lost], n) + inner]]
        chunk = np.searchsorted(begin, start, "right") - 1
        return np.bincount(chunk, size, len(texts)).astype(np.int64), ids

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block (marks already spaces) and their offsets."""
        some = block.sizes > 0
        off = block.off + np.concatenate([[0], np.cumsum(some)])
        data = np.zeros(int(off[-1]), np.uint8)
        body = np.ones(len(data), bool)
        body[off[:-1][some]] = False
        data[body], data[~body] = block.data, 32                # the leading space
        space = data == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[off[:-1][some]] = True
        begin = np.flatnonzero(new)
        lens = np.diff(np.append(begin, len(data)))

        def work(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n, ids = self.chunk_ids([data[begin[i]:begin[i] + lens[i]] for i in first])
            return n, ids.astype(np.uint32)
        ids, size = self.known.look_up(hash_spans(data, lens), work)
        return ids, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(begin, off)]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents and their offsets."""
        n = self.flat_len[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.arange(total) + np.repeat(self.flat_at[ids] - (ends - n), n)]
        at = np.concatenate([[0], ends])[off]
        some = at[1:] > at[:-1]
        lead = at[:-1][some]
        lead = lead[data[lead] == 32]
        keep = np.ones(total, bool)
        keep[lead] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def spaced(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(as_text(texts), MARK, " ")


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _texts(data: np.ndarray, off: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(off, off[1:])]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs(doc_id, text)``."""
    path = path or model_path()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(spaced(column(batch, "text")), BLOCK_BYTES):
                rows = column(batch, "doc_id")[block.first_row:block.first_row + block.n]
                yield pa.RecordBatch.from_arrays([rows, _lists(*encoder(path).encode(block))], ["doc_id", "ids"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(encoded, "doc_id long, ids array<int>"))


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ``docs(doc_id, ids)``; null ids are none."""
    path = path or model_path()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x.as_py() or [] for x in column(batch, "ids")]
            off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            ids = np.fromiter((i for x in lists for i in x), np.int64, int(off[-1]))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(_texts(*encoder(path).decode(ids, off)), pa.string())],
                ["doc_id", "text"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
            .mapInArrow(decoded, "doc_id long, text string"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids, restored``: the ids, and whether decoding them gives the text back."""
    path = path or model_path()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for block in blocks(spaced(column(batch, "text")), BLOCK_BYTES):
                ids, off = enc.encode(block)
                data, at = enc.decode(ids, off)
                same = np.diff(at) == block.sizes
                if same.all():
                    wrong = np.flatnonzero(data != block.data)
                    same[np.searchsorted(block.off, wrong, "right") - 1] = False
                else:
                    for d in np.flatnonzero(same):
                        same[d] = (data[at[d]:at[d + 1]] == block.data[block.off[d]:block.off[d + 1]]).all()
                rows = column(batch, "doc_id")[block.first_row:block.first_row + block.n]
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(np.diff(off)), _lists(ids, off), pa.array(same)],
                    ["doc_id", "n_tokens", "ids", "restored"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(both, "doc_id long, n_tokens long, ids array<int>, restored boolean"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
