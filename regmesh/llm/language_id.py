"""Language identification with bit-sliced Bloom filters over n-grams.

Training counts the byte ``GRAM``-grams of all training texts per language
(lower-cased words, one space between and around them).  A language contains
an n-gram if its rate there is at least ``LEAST_RATE``, one in a million, and
at least ``SHARE`` of the rate in the language where it is most common;
n-grams that languages share at like rates thus belong to all of them.

All languages' Bloom filters are one table: row = bit position, column =
language.  The rows at an n-gram's ``HASHES`` positions, and-ed, give at once
the bit mask of all languages that contain it.  A document's score for a
language is the share of its n-grams with that bit, less what false positives
of that filter would give by chance; the highest share decides, then the
language with more training text, then the name.

The rates of a language add up to one, so no corpus of any size gives it more
than ``1 / LEAST_RATE`` n-grams.  The table has the power of two of rows, at
least ``ROWS``, that keeps the filter of the language with most n-grams at
``FALSE_RATE`` false positives: at most 2^24 by that bound, which bounds what
is collected and sent to the tasks; beyond 63 languages it has further columns
of masks.  Texts are read twice and never shuffled.

Defined results: ``und`` with score 0 for a null text or one without a
letter, and for every text if nothing can be learned; a text without a known
n-gram gets the language with most training text and score 0; a null
``doc_id`` is not held out; repeated rows are predicted one by one; an empty
table gives no rows.  Columns other than ``doc_id, text, lang`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import fold, table, written
from .textvec import Block, as_text, blocks, column, mix

GRAM = 4
FOLDS, HELD = 4, 2
SHARE = 0.3
LEAST_RATE = 1e-6
ROWS = 1 << 20
HASHES = 3
FALSE_RATE = 0.01
MASK_BITS = 63
BLOCK_BYTES = 1 << 20
FLUSH_GRAMS = 2_000_000     # distinct (language, n-gram) counts a task holds before it emits them
UND = "und"


def grams(block: Block, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of every document's words, spaced, and their offsets per document.

    The stream of a document is a space, then each word followed by a space."""
    sizes = block.end - block.start
    some = block.n_words > 0
    # one byte more per word, one per document with words
    doc_bytes = np.add.reduceat(sizes + 1, block.word_off[:-1][some]) if some.any() else np.zeros(0, np.int64)
    length = np.zeros(block.n, np.int64)
    length[some] = doc_bytes + 1
    off = np.concatenate([[0], np.cumsum(length)])
    stream = np.full(int(off[-1]), 32, np.uint8)
    if len(stream):
        first = np.cumsum(sizes) - sizes                    # of each word in word_bytes
        shift = np.arange(len(sizes)) + np.cumsum(some)[block.word_doc]
        place = np.arange(len(block.word_bytes)) + np.repeat(shift, sizes)
        stream[place] = block.word_bytes
    return stream, off


def stream_grams(stream: np.ndarray, off: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(off)
    count = np.maximum(sizes - n + 1, 0)
    if len(stream) < n:
        return np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(count)])
    v = np.zeros(len(stream) - n + 1, np.uint64)
    for i in range(n):
        v = (v << np.uint64(8)) | stream[i:i + len(v)]
    ends = np.repeat(off[1:], sizes)[:len(v)]
    return v[np.arange(len(v)) + n <= ends], np.concatenate([[0], np.cumsum(count)])


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(as_text(texts))


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over ``docs(lang, text)``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def emit():
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)],
                    ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(column(batch, "lang").to_pylist(), object)
            for block in blocks(lowered(column(batch, "text")), BLOCK_BYTES):
                g, off = stream_grams(*grams(block))
                of = langs[block.first_row:block.first_row + block.n]
                for lang in set(of):
                    mine = np.repeat(of == lang, np.diff(off))
                    new, n = np.unique(g[mine], return_counts=True)
                    if lang in held:
                        old, m = held[lang]
                        both, inv = np.unique(np.concatenate([old, new]), return_inverse=True)
                        total = np.zeros(len(both), np.int64)
                        np.add.at(total, inv, np.concatenate([m, n]))
                        held[lang] = both, total
                    else:
                        held[lang] = new, n.astype(np.int64)
            if sum(len(g) for g, _ in held.values()) > FLUSH_GRAMS:
                yield from emit()
        yield from emit()
    return (docs.mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _positions(g: np.ndarray, rows: int) -> list[np.ndarray]:
    h = mix(g + np.uint64(0x51ED270B9F1A7D35))
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(rows)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    """``langs`` ordered by training text; ``masks`` one table of row masks per 63 languages."""
    langs: list[str]
    masks: list[np.ndarray]

    def false_rate(self) -> np.ndarray:
        return np.array([((self.masks[i // MASK_BITS] >> (i % MASK_BITS)) & 1).mean() ** HASHES
                         for i in range(len(self.langs))])

    def shares(self, g: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Documents x languages: corrected share of n-grams that each language contains."""
        size = np.diff(off)
        some = size > 0
        out = np.zeros((len(size), len(self.langs)))
        if not some.any():
            return out
        at = _positions(g, len(self.masks[0]))
        rate = self.false_rate()
        for w, table_ in enumerate(self.masks):
            mask = table_[at[0]]
            for p in at[1:]:
                mask = mask & table_[p]
            for i in range(w * MASK_BITS, min((w + 1) * MASK_BITS, len(self.langs))):
                bit = (mask >> (i - w * MASK_BITS)) & 1
                hits = np.add.reduceat(bit, off[:-1][some], dtype=np.int64)
                out[some, i] = np.clip((hits / size[some] - rate[i]) / max(1 - rate[i], 1e-9), 0, 1)
        return out


def rows_for(n: int, least: int) -> int:
    """Rows of a table whose fullest filter holds ``n`` n-grams; a power of two."""
    need = -HASHES * n / math.log(1 - FALSE_RATE ** (1 / HASHES))
    return max(least, 1 << max(0, math.ceil(need) - 1).bit_length())


def fit(docs: DataFrame, share: float = SHARE, rows: int = ROWS, least_rate: float = LEAST_RATE) -> Filters:
    """Learn from every row of ``docs(lang, text)`` with a non-null ``lang``; ``rows`` at least."""
    spark = docs.sparkSession
    counted = written(spark, count_grams(docs.filter(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text")), "gram-counts")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    order = [(r["lang"], r["total"]) for r in
             totals.orderBy(F.desc("total"), "lang").collect()]       # one row per language
    langs = [x for x, _ in order]
    if not langs:
        return Filters([], [])
    numbered = spark.createDataFrame(
        [(x, i // MASK_BITS, 1 << i % MASK_BITS, t) for i, (x, t) in enumerate(order)],
        "lang string, w int, mask long, total long")
    rate = F.col("n") / F.col("total")
    kept = (counted.join(F.broadcast(numbered), "lang").withColumn("rate", rate)
            .filter(F.col("rate") >= least_rate)
            .withColumn("top", F.max("rate").over(Window.partitionBy("gram")))
            .filter(F.col("rate") >= share * F.col("top")).select("gram", "w", "mask"))
    kept = written(spark, kept, "kept-grams")
    most = kept.groupBy("w", "mask").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    rows = rows_for(most or 0, rows)
    found = kept.groupBy("gram", "w").agg(F.bit_or("mask").alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = column(b, "gram").to_numpy().view(np.uint64)
            at = np.concatenate(_positions(g, rows)).astype(np.int32)
            again = pa.array(np.tile(np.arange(len(g)), HASHES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), column(b, "w").take(again), column(b, "mask").take(again)],
                ["row", "w", "mask"])
    sliced = (found.mapInArrow(place, "row int, w int, mask long")
              .groupBy("row", "w").agg(F.bit_or("mask").alias("mask")).toArrow())
    masks = [np.zeros(rows, np.int64) for _ in range(-(-len(langs) // MASK_BITS))]
    w, row, mask = (sliced[c].to_numpy() for c in ("w", "row", "mask"))
    for k, m in enumerate(masks):
        m[row[w == k]] = mask[w == k]
    return Filters(langs, [m.astype(np.uint8) if len(langs) <= 7 else m for m in masks])


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(as_text(texts), r"\pL").to_numpy(zero_copy_only=False)


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, UND], object)
        for batch in batches:
            texts = column(batch, "text")
            letters = has_letter(texts)
            lang = np.full(batch.num_rows, len(model.langs))
            score = np.zeros(batch.num_rows)
            for block in blocks(lowered(texts), BLOCK_BYTES) if model.langs else ():
                share = model.shares(*stream_grams(*grams(block)))
                rows = slice(block.first_row, block.first_row + block.n)
                lang[rows] = share.argmax(1)
                score[rows] = share.max(1) / np.maximum(share.sum(1), 1e-12)
            lang[~letters], score[~letters] = len(model.langs), 0.0
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(names[lang], pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(predicted, "doc_id long, lang_pred string, score double"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False))
    model = fit(docs.filter(~held).select("lang", "text"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
