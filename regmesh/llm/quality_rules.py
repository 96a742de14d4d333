"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio.

Base rules (fixed): fewer than 20 words, or more than 30 % of the words in
8-word windows that occur twice or more in the text.

The method's rule: byte ``GRAM``-grams of a text, hashed to ``BUCKETS``
buckets, are counted once over all documents (the raw corpus) and once over
those labelled as of good quality (the trusted target).  Both counts become
smoothed multinomials; a document's ratio is the mean over its n-grams of
log p_target - log p_raw, so its length does not matter.  A document below
``THRESHOLD`` nats is dropped.

Two passes over the texts, no shuffle of them: the first adds up counts (a
task emits at most ``BUCKETS`` rows), the second looks them up in the table
of ratios, whose size is fixed by ``BUCKETS``.  Counts are integers and each
document is summed on its own, so the verdict does not depend on how the
rows are dealt out.

Defined results: a null text counts as an empty one (no words, so the base
rules drop it); a text too short for an n-gram has ratio 0; without trusted
documents every ratio is 0 and only the base rules decide; a null
``doc_id`` is kept or dropped like any other, but is never trusted; repeated
rows count as often as they occur; an empty table gives no rows.  Only
``doc_id`` and ``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docstats import base_stats
from .tables import attach_small, keep_rows, labelled, table
from .textvec import Block, blocks, column, mix

GRAM = 4
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTH = 0.5
THRESHOLD = -0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def gram_buckets(block: Block, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte n-gram inside a document, and offsets per document."""
    sizes = np.maximum(block.sizes - n + 1, 0)
    off = np.concatenate([[0], np.cumsum(sizes)])
    if not off[-1]:
        return np.zeros(0, np.int64), off
    v = np.zeros(len(block.data) - n + 1, np.uint64)
    for i in range(n):
        v = (v << np.uint64(8)) | block.data[i:i + len(v)]
    inside = np.ones(len(v), bool)
    for i in range(1, n):                       # starts too close to a document's end
        ends = block.off[1:] - i
        inside[ends[(ends >= 0) & (ends < len(v))]] = False
    if block.sizes.min(initial=n) < n:          # short documents: be exact about each start
        doc_end = np.repeat(block.off[1:], block.sizes)[:len(v)]
        inside = np.arange(len(v)) + n <= doc_end
    return (mix(v[inside]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), off


def counts(docs: DataFrame) -> DataFrame:
    """``bucket, raw, target`` over all rows of ``docs(text, trusted)``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            trusted = column(batch, "trusted").to_numpy(zero_copy_only=False).astype(bool)
            for block in blocks(column(batch, "text")):
                bucket, off = gram_buckets(block)
                raw += np.bincount(bucket, minlength=BUCKETS)
                good = np.repeat(trusted[block.first_row:block.first_row + block.n], np.diff(off))
                target += np.bincount(bucket[good], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])],
            ["bucket", "raw", "target"])
    return (docs.mapInArrow(count, "bucket int, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def ratios(counted: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket (at most ``BUCKETS`` rows reach the driver)."""
    got = counted.toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got["bucket"].to_numpy()
    raw[at], target[at] = got["raw"].to_numpy(), got["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    return (np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS))
            - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    good = (labelled(labels, "quality").filter(F.col("label") == 1)
            .select("doc_id", F.lit(True).alias("trusted")))
    marked = attach_small(docs.select("doc_id", "text"), good, ["doc_id"], "left")
    return ratios(counts(marked.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))))


def batch_ratio(texts: pa.Array, table_: np.ndarray) -> np.ndarray:
    """Mean ratio of each text's n-grams."""
    out = []
    for block in blocks(texts):
        bucket, off = gram_buckets(block)
        size = np.diff(off)
        total = np.zeros(block.n)
        some = size > 0
        if some.any():
            total[some] = np.add.reduceat(table_[bucket], off[:-1][some])
        out.append(total / np.maximum(size, 1))
    return np.concatenate(out) if out else np.zeros(0)


def batch_base(texts: pa.Array) -> dict[str, np.ndarray]:
    parts = [base_stats(b) for b in blocks(texts)]
    out = {k: np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
           for k in BASE}
    out["base_failed"] = ((out["n_words"] < MIN_WORDS)
                          | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]))
    return out


def rate(docs: DataFrame, table_: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its base statistics, ratio and verdict."""
    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            base, ratio = batch_base(texts), batch_ratio(texts, table_)
            kept = ~base["base_failed"] & (ratio >= threshold)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *[pa.array(base[k]) for k in BASE],
                 pa.array(base["base_failed"]), pa.array(kept), pa.array(ratio)],
                ["doc_id", *BASE, "base_failed", "kept", "log_ratio"])
    schema = ("doc_id long, " + ", ".join(f"{k} long" for k in BASE)
              + ", base_failed boolean, kept boolean, log_ratio double")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rated, schema))


def keep_passing(docs: DataFrame, table_: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass every rule, with all their columns."""
    def mask(batch: pa.RecordBatch) -> np.ndarray:
        texts = column(batch, "text")
        return ~batch_base(texts)["base_failed"] & (batch_ratio(texts, table_) >= threshold)
    return keep_rows(docs, mask)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_passing(docs, fit(docs, table(spark, sf_dir, "labels")))
