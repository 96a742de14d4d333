"""Benchmark decontamination with an FM-index per training shard (operator 13).

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: ASCII digits,
letters and everything beyond ASCII.  A window is ``WINDOW`` consecutive words of a benchmark
item; an item with fewer words, but not none, is one window.

Plan.  No row of the corpus is shuffled.  A task numbers the words of its documents in turn, and
each run of about ``SHARD_WORDS`` words becomes one index (``fm_index``): the text is laid out in
passages of ``PASSAGE`` words, the next one starting ``WINDOW - 1`` words before the last one
ends, so that every window lies in a passage and the suffix sort never has to compare more than a
passage.  The windows, each different one once, are searched backwards through the wavelet ranks,
their rows located by the sampled suffix positions, and the occurrences merged into spans.

The benchmark is a stated query set: it is cut into blocks of at most about ``BLOCK_BYTES`` of
text, each broadcast by itself, and every index meets every block.  A task holds one block at a
time, so a benchmark of any size passes; the driver holds one block while it is prepared.

Results for odd input: a null or empty text has no words, no spans and no items; a null item text
has no window; windows of an item without an id hit, but the item cannot be listed; rows of one
``item_id`` are one item, equal rows of ``documents`` each get their own result; an empty
benchmark hits nothing; empty documents give no rows.  All columns of ``documents`` are kept; a
column called ``contamination`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .tables import table, written

WINDOW = 10
SHARD_WORDS = 1 << 20
PASSAGE = 127               # words of a passage (its separator makes 128)
BLOCK_BYTES = 4 << 20       # benchmark text in one broadcast block
CHUNK_WORDS = 2048          # a longer item is dealt to blocks in chunks

# What a byte counts as: A-Z lower-cased, digits, a-z and non-ASCII kept, the rest a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
                   else 32 for b in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType()))])


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


# ---- the benchmark ----

def chunks(benchmark: DataFrame, window: int) -> DataFrame:
    """``item_id, words, block_key``: the items' words, long items cut so that each window is in
    one chunk."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), CHUNK_WORDS):
                    ids.append(item)
                    texts.append(b" ".join(words[at:at + CHUNK_WORDS + window - 1]).decode())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                                  names=["item_id", "words"])
    return (benchmark.select(F.col("item_id").cast("string"), "text")
            .mapInArrow(cut, "item_id string, words string").distinct())


def _compiled(rows: list, window: int) -> dict:
    """A block ready for the search: its words, the different windows and the items of each."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    names = sorted({r["item_id"] for r in rows if r["item_id"] is not None})
    item_no = {name: i for i, name in enumerate(names)}
    by_width: dict[int, list] = defaultdict(list)
    for r in rows:
        ids = np.fromiter(map(number.__getitem__, r["words"].encode().split()), np.int64)
        wins = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
        by_width[wins.shape[1]].append((wins, item_no.get(r["item_id"], -1)))
    groups = []
    for width, parts in sorted(by_width.items()):
        wins = np.concatenate([w for w, _ in parts])
        item = np.concatenate([np.full(len(w), i) for w, i in parts])
        distinct, which = np.unique(wins, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), item], axis=1)[item >= 0], axis=0)
        ends = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        groups.append((distinct.astype(np.int32), pairs[:, 1].astype(np.int32), ends))
    return {"vocabulary": list(number), "names": names, "groups": groups}


def query_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """The benchmark as broadcast blocks of at most about ``block_bytes`` of text each."""
    spark = benchmark.sparkSession
    parts = written(spark, chunks(benchmark, window), "benchmark-chunks")
    total = parts.agg(F.sum(F.octet_length("words"))).first()[0]
    n = -(-(total or 0) // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(max(n, 1)))
    return [spark.sparkContext.broadcast(_compiled(parts.filter(block == b).collect(), window))
            for b in range(n)]


# ---- one shard ----

class Shard:
    """Documents whose words are searched together: numbered words, and what was found."""

    def __init__(self, window: int):
        self.window = window
        self.number: dict[bytes, int] = defaultdict(count(1).__next__)
        self.parts: list[np.ndarray] = []
        self.lens: list[int] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        words = words_of(text)
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.lens.append(len(words))
        self.size += len(words)

    def search(self, blocks: list) -> tuple[np.ndarray, list[list[str]]]:
        """Which words are hit, and the items of each document."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        lens = np.array(self.lens, np.int64)
        ends = np.cumsum(lens)
        edges = np.zeros(self.size + 1, np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for index, origin in self._indexes(ids, lens):
            for block in blocks:
                self._search_block(index, origin, block.value, ends, edges, items)
        return np.cumsum(edges[:-1]) > 0, [sorted(items.get(d, ())) for d in range(len(lens))]

    def _indexes(self, ids: np.ndarray, lens: np.ndarray) -> Iterator[tuple[FMIndex, np.ndarray]]:
        """Indexes of at most ``SHARD_WORDS`` symbols with the word that each symbol is."""
        stride = PASSAGE - self.window + 1
        n = np.maximum(-(-(lens - self.window + 1) // stride), lens > 0)
        doc_end = np.repeat(np.cumsum(lens), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(lens) - lens, n) + k * stride
        length = np.minimum(PASSAGE, doc_end - start)
        step = max(SHARD_WORDS // (PASSAGE + 1), 1)
        for a in range(0, len(start), step):
            s, m = start[a:a + step], length[a:a + step] + 1
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            origin = np.repeat(s, m) + at
            last = np.cumsum(m) - 1
            symbols = ids[np.minimum(origin, len(ids) - 1)].astype(np.int64)
            symbols[last] = 0
            yield FMIndex(symbols), origin

    def _search_block(self, index: FMIndex, origin: np.ndarray, block: dict, ends: np.ndarray,
                      edges: np.ndarray, items: dict[int, set[str]]) -> None:
        here = np.fromiter((self.number.get(w, 0) for w in block["vocabulary"]), np.int64)
        for windows, item, item_ends in block["groups"]:
            low, high = index.search(here[windows])
            hits = high - low
            found = np.flatnonzero(hits)
            if not len(found):
                continue
            each = hits[found]
            rows = (np.repeat(low[found], each) + np.arange(each.sum())
                    - np.repeat(np.cumsum(each) - each, each))
            word = origin[index.locate(rows)]
            np.add.at(edges, word, 1)
            np.add.at(edges, word + windows.shape[1], -1)
            doc = np.searchsorted(ends, word, side="right")
            pairs = np.unique(doc * len(windows) + np.repeat(found, each))
            for d, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist()):
                items[d].update(block["names"][i] for i in item[item_ends[w]:item_ends[w + 1]])


def _spans(text: str, flags: np.ndarray) -> list[dict]:
    """The runs of hit words, as word numbers and as code points ``[start, end)`` of the text."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(WORD_BYTES, np.uint8)[raw] != 32
    step = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(step == 1)[first], np.flatnonzero(step == -1)[last]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [dict(zip(("first_word", "last_word", "start", "end"), row)) for row in
            zip(first.tolist(), last.tolist(), points[begin].tolist(), points[end].tolist())]


# ---- the operator ----

def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``contamination``: the number of words and of hit words, the merged spans to
    remove (word numbers from 0, last one included; code points, end excluded) and the ids of the
    items with an occurring window, sorted as strings."""
    blocks = query_blocks(benchmark, window, block_bytes)
    kept = [c for c in docs.columns if c.lower() != "contamination"]
    df = docs.select(*kept)
    place = [c.lower() for c in kept].index(text.lower())
    schema = T.StructType([*df.schema.fields, T.StructField("contamination", RESULT)])
    typed = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                       ("spans", pa.list_(pa.struct([(k, pa.int64()) for k in
                                                     ("first_word", "last_word", "start", "end")]))),
                       ("item_ids", pa.list_(pa.string()))])

    def finished(shard: Shard, waiting: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(waiting).combine_chunks()
        flags, items = shard.search(blocks)
        values, at = [], 0
        for row, (n, ids) in enumerate(zip(shard.lens, items)):
            mine = flags[at:at + n]
            hit = int(mine.sum())
            values.append({"n_words": n, "n_hit": hit, "item_ids": ids,
                           "spans": _spans(whole.column(place)[row].as_py(), mine) if hit else []})
            at += n
        whole = whole.append_column("contamination", pa.array(values, typed))
        return whole.combine_chunks().to_batches()[0]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = Shard(window), []
        for batch in batches:
            # slices of a batch, so that a shard ends where it is full
            start = 0
            for i, value in enumerate(batch.column(place).to_pylist()):
                shard.add(value)
                if shard.size >= shard_words:
                    waiting.append(batch.slice(start, i + 1 - start))
                    yield finished(shard, waiting)
                    shard, waiting, start = Shard(window), [], i + 1
            if start < batch.num_rows:
                waiting.append(batch.slice(start))
        if waiting:
            yield finished(shard, waiting)
    return df.mapInArrow(searched, schema)


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The texts without their spans (each one becomes a single blank)."""
    place = found.columns.index(text)
    result = found.columns.index("contamination")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, value in enumerate(batch.column(result).to_pylist()):
                for span in reversed(value["spans"] if value else []):
                    texts[i] = texts[i][:span["start"]] + " " + texts[i][span["end"]:]
            yield batch.set_column(place, batch.schema.field(place),
                                   pa.array(texts, batch.schema.field(place).type))
    return found.mapInArrow(cut, found.schema)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``; the contract's digest columns."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                          table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ",").cast("binary"), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"))


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  coalesce(regexp_extract_all({_LOWER}, '{_WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark
      WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win,
              least(len(w), {WINDOW}) AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i
             FROM b WHERE len(w) > 0) x),
widths AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT d.r, d.w, k, unnest(range(1, len(d.w) - k + 2)) AS i FROM d, widths) y),
occ AS (SELECT DISTINCT r, i, dw.k, win FROM dw SEMI JOIN bw USING (win, k)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit
        FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) z GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM occ JOIN bw USING (win, k)
              WHERE item_id IS NOT NULL) v GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)"""
