"""Best-fit packing, planned on the histogram of lengths.

1. One pass tokenises every text and cuts what is longer than ``CAPACITY``
   tokens into pieces; narrow rows (ids on request) are written once.
2. The histogram of piece lengths, at most ``CAPACITY`` rows, is planned on
   the driver: best fit by decreasing length over counts.  Sequences with
   equal room form ranges of consecutive numbers; placing ``n`` pieces of a
   length is one plan row ``(length, first_rank, n, first_sequence, offset)``,
   however large ``n`` is.
3. Every piece takes its rank among the pieces of its length and joins the
   plan row that holds the rank: sequence = first_sequence + rank -
   first_rank.  Ranks are counted in salted groups of bounded size, dealt by
   a piece's place in the first pass, so a length that most pieces share is
   spread over many tasks, null ids and repeated rows included.

Defined results: a null text counts as an empty one, whose only token is the
end token; rows with a null ``doc_id`` are packed like others; repeated rows
are packed one by one (they are interchangeable); an empty table gives no
rows.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table, written
from .textvec import Block, SpanTable, blocks, column

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 1 << 19           # arrays over a block's bytes are a few dozen times as large
RANK_TARGET = 20_000            # pieces of one length that one task numbers
PLAN_ROWS = 500_000             # a plan of up to this many rows is broadcast


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


class RankEncoder:
    """The tokenizer's ids of plain words, many times as fast as the library one word at a time.

    The vocabulary is byte pairs whose last symbol of a (sub)word carries ``</w>``, ids in the order
    of merges.  With a mark behind each subword, ``</w>`` is the merge of a byte and the mark, which
    comes before all others; the rest are byte pairs by rank.  Plain: Latin-1 without controls,
    blanks and ``<|`` (a special token may be in it), where lower-casing and letter classes are
    the same everywhere and nothing composes.  ``of`` gives None for any other kind of tokenizer.
    """
    MARK, SUFFIX = "\x00", "</w>"
    PLAIN = r"[!-~\xa1-\xff]+"

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import regex
        import tiktoken
        self.coder = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.plain, self.alpha = re.compile(self.PLAIN), re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")
        self.parts = regex.compile(pattern).findall
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = len(token) > 1 and token.endswith(b"\x00")

    @classmethod
    def of(cls, path: str) -> RankEncoder | None:
        import json

        from .token_alignment import byte_values
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, words = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if (model["type"] != "BPE" or model["end_of_word_suffix"] != cls.SUFFIX or model["ignore_merges"]
                or [w["type"] for w in words] != ["Split", "ByteLevel"] or words[1]["use_regex"]
                or words[1]["add_prefix_space"] or not words[0]["invert"] or words[0]["behavior"] != "Removed"
                or steps != [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]):
            return None
        value, vocab = byte_values(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for entry, i in vocab.items():
            if entry in special:
                continue
            mark = entry.endswith(cls.SUFFIX)
            token = bytes(value[c] for c in (entry[:-len(cls.SUFFIX)] if mark else entry)) + b"\x00" * mark
            if token != b"\x00\x00":               # a mark behind a mark: such texts are not plain
                ranks[token] = i
        ids = [vocab["".join(m)] for m in merges]
        first = [i for t, i in ranks.items() if len(t) == 1 or (len(t) == 2 and t[1] == 0)]
        if ids != sorted(set(ids)) or max(first) >= ids[0]:
            return None
        return cls(ranks, words[0]["pattern"]["Regex"])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of plain texts."""
        low = [t.lower() for t in texts]
        parts = [(t,) if self.alpha.fullmatch(t) else self.parts(t) for t in low]
        got = self.coder.encode_ordinary("\x00".join([p for w in parts for p in w] + [""]))
        ids = np.array(got, np.uint32)
        last = np.flatnonzero(self.ends[ids]) + 1                           # where each subword ends
        bound = np.concatenate([[0], last])[np.cumsum([0] + [len(w) for w in parts])]
        return np.diff(bound), ids


class WordEncoder:
    """Token ids of texts, word by word.

    The tokenizer drops white space and never merges across it, so a text's
    ids are those of its words; words met before come from a ``SpanTable``.
    New words that are plain go through ``RankEncoder``, others through the library.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = RankEncoder.of(path)
        self.known = SpanTable(slots=1 << 20, keep=4_000_000)

    def new_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of words."""
        plain = np.zeros(len(texts), bool)
        if self.ranked:
            fits = self.ranked.plain.fullmatch
            plain[:] = [fits(t) is not None and "<|" not in t for t in texts]
        got = [x.ids for x in self.tokenizer.encode_batch_fast(
            [texts[i] for i in np.flatnonzero(~plain)], add_special_tokens=False)]
        lens = np.zeros(len(texts), np.int64)
        lens[~plain] = [len(x) for x in got]
        fast = np.zeros(0, np.uint32)
        if plain.any():
            lens[plain], fast = self.ranked.encode([texts[i] for i in np.flatnonzero(plain)])
        ids = np.empty(int(lens.sum()), np.uint32)
        of_plain = np.repeat(plain, lens)
        ids[of_plain] = fast
        ids[~of_plain] = [i for x in got for i in x]
        return lens, ids

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, each followed by ``END``, and their offsets."""
        def work(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            raw = block.data.tobytes()
            return self.new_words([raw[s:e].decode("utf-8", "replace") for s, e in
                                   zip(block.start[words].tolist(), block.end[words].tolist())])

        ids, size = self.known.look_up(block.word_hash, work)
        per_word = np.concatenate([[0], np.cumsum(size)])
        off = per_word[block.word_off] + np.arange(block.n + 1)
        out = np.full(int(off[-1]), END, np.uint32)
        body = np.ones(len(out), bool)
        body[off[1:] - 1] = False
        out[body] = ids
        return out, off


_ENCODERS: dict[str, WordEncoder] = {}      # per worker process: its word table outlives a task


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        enc = _ENCODERS[path]
        for batch in batches:
            doc_ids = column(batch, "doc_id")
            for block in blocks(column(batch, "text"), BLOCK_BYTES):
                ids, off = enc.encode(block)
                size = np.diff(off)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(block.n), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                first = off[doc] + start
                raw = ids.astype("<u4").view(np.uint8)
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(first, length)]
                cols = [doc_ids.take(pa.array(doc + block.first_row)), pa.array(piece.astype(np.int32)),
                        pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:                # pieces follow each other in ids without gaps
                    cols.append(pa.ListArray.from_arrays(
                        pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long"
              + ", ids array<int>" * with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit by decreasing length: rows ``(length, first_rank, n, first_sequence, offset)``."""
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}     # room left -> ranges (first sequence, sequences)
    keys: list[int] = []                            # the rooms that have ranges, in order
    opened = 0

    def give(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(keys, left)
            room[left].append((first, n))

    for length in sorted(histogram, reverse=True):
        need, rank = histogram[length], 0

        def fill(left: int, first: int, n: int) -> None:
            """Put as many of ``length`` as fit into each of ``n`` sequences with ``left`` room."""
            nonlocal need, rank
            fit = left // length
            full = min(n, need // fit)
            for j in range(fit if full else 0):
                rows.append((length, rank, full, first, capacity - left + j * length))
                rank += full
            need -= full * fit
            give(left - fit * length, first, full)
            if full < n and need:                   # the last of them are fewer than fit in one
                for j in range(need):
                    rows.append((length, rank, 1, first + full, capacity - left + j * length))
                    rank += 1
                give(left - need * length, first + full, 1)
                need, full = 0, full + 1
            give(left, first + full, n - full)

        while need:
            at = bisect.bisect_left(keys, length)
            if at == len(keys):
                n = -(-need // (capacity // length))
                opened, first = opened + n, opened
                fill(capacity, first, n)
                continue
            left = keys[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], keys[at]
            fill(left, first, n)
    return rows


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    # the place of a piece in the pass that wrote it tells apart null ids and repeated rows
    cut = written(spark, pieces(docs, capacity, path, with_ids)
                  .withColumn("place", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in
                 cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}   # <= capacity rows
    rows = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    planned = spark.createDataFrame(pa.table(
        dict(zip(("length", "first_rank", "n", "first_sequence", "offset"), rows.T))))
    salts = spark.createDataFrame(pa.table({
        "length": pa.array(list(histogram), pa.int64()),
        "salts": pa.array([-(-n // RANK_TARGET) for n in histogram.values()], pa.int32())}))
    salted = (cut.join(F.broadcast(salts), "length")
              .withColumn("salt", F.pmod(F.xxhash64("place"), F.col("salts"))))
    before = (salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("before", F.coalesce(F.sum("_c").over(
                  Window.partitionBy("length").orderBy("salt")
                  .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c"))
    inner = Window.partitionBy("length", "salt").orderBy("place")
    ranked = (salted.withColumn("_rn", F.row_number().over(inner) - 1)
              .join(before, ["length", "salt"])
              .withColumn("rank", F.col("_rn") + F.col("before")))
    # the plan's size follows the number of lengths, not of documents
    side = F.broadcast(planned) if len(rows) <= PLAN_ROWS else planned
    side = side.withColumnRenamed("length", "_length")
    placed = ranked.join(side, (F.col("length") == F.col("_length"))
                         & (F.col("rank") >= F.col("first_rank"))
                         & (F.col("rank") < F.col("first_rank") + F.col("n")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset", *(["ids"] if with_ids else []))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)
