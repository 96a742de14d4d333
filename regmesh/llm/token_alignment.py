"""Cross-tokenizer alignment by cumulative byte ends (operator 12).

Two public tokenizers cut the same bytes: A (byte-level BPE) encodes blank + text, B (BPE pieces
with byte fallback) encodes the text and adds the blank itself.  For each document the cumulative
ends of the tokens go into a dictionary end -> index per side; the hash-set intersection of the
keys, sorted, cuts both id lists into groups, and each group gives its links: the pairs of an A
and a B token that end where the group ends.  (A token without bytes ends where its predecessor
does, so it is linked there too.)

Plan.  One pass over the texts encodes, aligns and writes per document its counts, its group
digest and its different links with how often each occurs, as packed binary of 12 bytes a link;
nothing is encoded twice.  Corpus counts are one map-side combined aggregation of id pairs, at
most one row per pair of the vocabularies.  The counts come back to the documents by a broadcast
of the sorted pair table where it has at most ``TABLE_ROWS`` rows (16 bytes each, counted before)
and beyond that by a join of the exploded links, salted for pairs that most documents hold.  Both
ways give the same rows.

Results for odd input: texts that are null, empty, or not given back byte for byte by either side
(B normalises some characters) have no tokens: zeros and an empty digest.  Strings of special
tokens inside a text are plain text.  Equal rows and rows of one ``doc_id`` each get their own
result (rows are told apart by the task and the place that wrote them); empty tables give no rows.
All columns of ``docs`` are kept; ones called like a column of the result are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import hot_keys, salted_join
from .tables import table, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
TABLE_ROWS = 4_000_000      # a pair table of this many rows (64 MB) may be broadcast
BATCH_CHARS = 1 << 20       # texts encoded together

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
LINK = np.dtype([("a", "<i4"), ("b", "<i4"), ("n", "<i4")])


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes, in order, for U+0100 and on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers with the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = byte_values()
        vocabulary = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(value[c] for c in entry) if all(c in value for c in entry) else b""
        self.fast = self._ranked(a_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.a_lens = [len(x) for x in self.a_bytes]
        self.b_lens = [len(x) for x in self.b_bytes]
        self.b_from = 2 * len(self.a_bytes)
        self.written = np.array([f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                                 for i in range(n) for end in ends], object)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides, none where a side does not give the bytes of blank + text back."""
        full = [x or "" for x in texts]
        left = [self.fast.encode_ordinary(" " + x) if self.fast and _latin(x) else None for x in full]
        rest = [i for i, ids in enumerate(left) if ids is None]
        for i, found in zip(rest, self.a.encode_batch_fast([" " + full[i] for i in rest],
                                                           add_special_tokens=False)):
            left[i] = found.ids
        right = self.b.encode(full, num_threads=1)
        for text, a, b in zip(full, left, right):
            want = b" " + text.encode()
            if (text and b"".join([self.a_bytes[i] for i in a]) == want
                    and b"".join([self.b_bytes[i] for i in b]) == want):
                yield a, b
            else:
                yield [], []

    def _ranked(self, a_path: str):
        """A's vocabulary as an encoder by ranks, about four times as fast as by its merges, where
        its file allows: no normaliser, plain byte-level words, and ids in the order of merges."""
        import json

        import public_tokenizers
        import tiktoken
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        model, words = spec["model"], spec["pre_tokenizer"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if (spec.get("normalizer") or not words or words.get("type") != "ByteLevel"
                or not words.get("use_regex", True) or not merges or ids != sorted(set(ids))):
            return None
        value = byte_values()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {self.a_bytes[i]: i for entry, i in model["vocab"].items() if entry not in special}
        if len(ranks) != len(value) + len(ids):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})

    def align(self, a: list[int], b: list[int]) -> tuple[int, np.ndarray, np.ndarray, str]:
        """Number of groups, the A and B ids of all links, and the digest of the groups."""
        if not a:
            return 0, np.zeros(0, np.int64), np.zeros(0, np.int64), ""
        a_end = list(accumulate(map(self.a_lens.__getitem__, a)))
        b_end = list(accumulate(map(self.b_lens.__getitem__, b)))
        a_at, b_at = dict(zip(a_end, count())), dict(zip(b_end, count()))     # last token of an end
        common = sorted(a_at.keys() & b_at.keys())
        a_last = np.fromiter(map(a_at.__getitem__, common), np.int64, len(common))
        b_last = np.fromiter(map(b_at.__getitem__, common), np.int64, len(common))
        ids_a, ids_b = np.array(a), np.array(b)
        if len(a_at) == len(a) and len(b_at) == len(b):
            link_a, link_b = ids_a[a_last], ids_b[b_last]
        else:                                   # tokens without bytes end together with others
            pairs = [(x, y) for end, i, j in zip(common, a_last.tolist(), b_last.tolist())
                     for x in a[bisect_left(a_end, end, 0, i):i + 1]
                     for y in b[bisect_left(b_end, end, 0, j):j + 1]]
            link_a, link_b = np.array(pairs, np.int64).T
        return len(common), link_a, link_b, self._digest(ids_a, ids_b, a_last, b_last)

    def _digest(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> str:
        """sha256 of ``a1,a2|b1;...``: each id is a ready string with its separator, and its place
        is its own index plus the ids of the other side that come before it."""
        text = np.empty(len(a) + len(b), np.int64)
        a_code, b_code = a * 2, b * 2 + self.b_from
        a_code[a_last] += 1
        b_code[b_last] += 1
        text[np.arange(len(a)) + np.repeat(np.append(0, b_last[:-1] + 1), np.diff(a_last, prepend=-1))] = a_code
        text[np.arange(len(b)) + np.repeat(a_last + 1, np.diff(b_last, prepend=-1))] = b_code
        return sha256("".join(self.written[text].tolist())[:-1].encode()).hexdigest()


def _latin(text: str) -> bool:
    """Whether both encoders class all characters alike: Latin-1 is the same in all Unicode versions."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    """The different links in order, each with its number."""
    key, n = np.unique(a << 32 | b, return_counts=True)
    out = np.empty(len(key), LINK)
    out["a"], out["b"], out["n"] = key >> 32, key & 0xFFFFFFFF, n
    return out.tobytes()


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of about ``BATCH_CHARS`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= BATCH_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def aligned(docs: DataFrame, text: str = "text",
            paths: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with a row number, the counts, the digest and the packed links."""
    a_path, b_path = paths or tokenizer_paths()
    names = [*COUNTS, "groups_sha256", "links", "row_no", "n_best", "count_sum"]
    kept = [c for c in docs.columns if c.lower() not in names]
    df = docs.select(*kept, F.col(text).alias("_text_of"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("row_no", T.LongType()),
                           *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("groups_sha256", T.StringType()),
                           T.StructField("links", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, stop in _runs(texts):
                found = []
                for a, b in both.encode(texts[start:stop]):
                    n, link_a, link_b, digest = both.align(a, b)
                    found.append((row, len(a), len(b), n, len(link_a), digest, _packed(link_a, link_b)))
                    row += 1
                columns = [pa.array(c, t) for c, t in
                           zip(zip(*found), [*[pa.int64()] * 5, pa.string(), pa.binary()])]
                part = batch.slice(start, stop - start)
                yield pa.record_batch([*part.columns[:-1], *columns], names=schema.names)
    return df.mapInArrow(run, schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """``a, b, n, best``: links of each id pair in the corpus; best where no pair of its B id has
    more."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(0).to_pylist()), LINK)
            key, which = np.unique(data["a"].astype(np.int64) << 32 | data["b"], return_inverse=True)
            n = np.bincount(which, weights=data["n"], minlength=len(key)).astype(np.int64)
            yield pa.record_batch([pa.array((key >> 32).astype(np.int32)),
                                   pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)],
                                  names=["a", "b", "n"])
    spark = links.sparkSession
    counts = written(spark, links.select("links").mapInArrow(unpack, "a int, b int, n long")
                     .groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("_top"))
    return counts.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("_top")).alias("best"))


def _scored_by_table(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Scores by binary search in the broadcast pair table."""
    rows = counts.toArrow()
    key = rows["a"].to_numpy().astype(np.int64) << 32 | rows["b"].to_numpy()
    order = np.argsort(key)
    shared = links.sparkSession.sparkContext.broadcast(
        (key[order], rows["n"].to_numpy()[order], rows["best"].to_numpy(zero_copy_only=False)[order]))
    kept = [c for c in links.columns if c != "links"]
    place = links.columns.index("links")
    schema = T.StructType([*links.select(*kept).schema.fields, T.StructField("n_best", T.LongType()),
                           T.StructField("count_sum", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            packed = batch.column(place).to_pylist()
            data = np.frombuffer(b"".join(packed), LINK)
            at = np.searchsorted(keys, data["a"].astype(np.int64) << 32 | data["b"])
            ends = np.cumsum([len(p) // LINK.itemsize for p in packed])
            totals = [np.concatenate([[0], np.cumsum(data["n"] * x[at])])
                      for x in (best.astype(np.int64), n)]
            sums = [t[ends] - t[np.concatenate([[0], ends[:-1]])] for t in totals]
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.record_batch([*columns, *[pa.array(s, pa.int64()) for s in sums]], names=schema.names)
    return links.mapInArrow(score, schema)


def _scored_by_join(links: DataFrame, counts: DataFrame) -> DataFrame:
    """Scores by a salted join of the exploded links with the pair table."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(1).to_pylist()
            data = np.frombuffer(b"".join(packed), LINK)
            rows = np.repeat(batch.column(0).to_numpy(), [len(p) // LINK.itemsize for p in packed])
            yield pa.record_batch([pa.array(rows), *[pa.array(np.ascontiguousarray(data[c]))
                                                     for c in LINK.names]],
                                  names=["row_no", "a", "b", "times"])
    flat = links.select("row_no", "links").mapInArrow(unpack, "row_no long, a int, b int, times int")
    weights = flat.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_rows"))
    sums = (salted_join(flat, counts, ["a", "b"], "inner", hot_keys(weights, ["a", "b"], "_rows"))
            .groupBy("row_no")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"),
                 F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    return (links.drop("links").join(sums, "row_no", "left")
            .fillna(0, ["n_best", "count_sum"]))


def align_tokens(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None,
                 table_rows: int = TABLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``, and the
    corpus' pair table ``a, b, n, best`` (the alignment itself: which A id stands for which B id)."""
    spark = docs.sparkSession
    links = written(spark, aligned(docs, text, paths), "token-links")
    counts = written(spark, pair_counts(links), "token-pairs")
    by = _scored_by_table if counts.count() <= table_rows else _scored_by_join
    return by(links, counts).drop("row_no"), counts


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, aligned; the contract's columns."""
    docs, _ = align_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
