"""Language-model scoring with Elias-Fano tries of word n-grams that Spark shards.

Tokens are A-Z lower-cased words and one end per text.  Words, word pairs and
word triples of the training texts are all kept; contexts start anew with each
text.  Each order is interpolated with the one below by absolute discounting:
of a context seen c times with k different tokens after it, a token has
max(n - D, 0) / c, and the mass that the discount takes, D k / c, goes to the
order below.

The score is a probability of the text.  The lowest order is a token's
discounted share, max(c - D, 0) / N, and of the mass that the discount takes,
D V / N, what its spelling gets: a word is its bytes and a space, the end is a
line feed, and each byte is predicted from the two before it within the word,
by counts over the training vocabulary.  So an unseen word costs its spelling,
and every order sums to one over all tokens (but for the 8-bit codes of pairs
and triples and the little that spelling gives to white space).

``base_score`` counts all unseen words as one type and is no such probability;
it is kept apart.  ``spelling_score`` is the spelling alone, ``unigram_score``
the lowest order alone.

1. Texts are read once and cut into chunks of ``CHUNK_BYTES``: each chunk
   keeps its tokens as numbers into its list of distinct words and deals that
   list, with counts, over the shards of the vocabulary.
2. A vocabulary shard merges its lists.  Training words get dense ids, more
   frequent ones smaller, and answer every list with id, count and log10
   probability of the spelling.  Each chunk numbers its tokens anew in the
   order of the ids; the chunks and the vocabulary are deleted then.
3. Each chunk, now in ids, lists its distinct pairs and triples with counts as
   packed steps of sorted columns, one row per shard of their contexts, without
   what the shard tells of them.  A shard merges them into a trie
   (``elias_fano.Trie``): levels with pointers, quantised shares and weights.
4. The same lists are the questions: the trie answers each with two codes, and
   a batch of chunks with the values of those that occur; the chunks add up
   their documents.

A list is shuffled once.  Where a shard may have more than ``PART_GRAMS``
listed n-grams, parts of it merge first, so a task holds a part or the
distinct n-grams of a shard, and each part answers its own.  All n-grams of one context are in one shard: at most one
for each different word, however often the context occurs.  The driver holds
the spelling's byte triples, at most 2^24 of them, and a few sums.

Defined results: a null text is empty (its one token is the end); a null
``doc_id`` is not held out and is learnt from; repeated rows are learnt from
and scored one by one; without training documents N and V are 0 and the
model is uniform over bytes; an empty table gives no rows.  Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .elias_fano import MISSING, Trie, load, save
from .tables import attach_small, fold, kept, table, written
from .textvec import Block, blocks, column, mix

DISCOUNT = 0.75
FOLDS, HELD = 7, 2
CHUNK_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
WORD_SHARD, GRAM_SHARD = 32 << 20, 12 << 20     # bytes of text for each shard of words and of pairs or triples
PART_GRAMS = 8_000_000                          # listed n-grams that a task merges or answers
BATCHES, BATCH_CHUNKS = 512, 16                 # chunks are answered and scored in so many batches, or of so many chunks
END, START, UNSEEN, FIRST_ID = 0, 1, 2, 3       # ids that are no words
SPACE_, END_ = 32, 10
WORD, PAIR, TRIPLE = 0, 1, 2


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, each as the bytes of its least width, plane by plane, compressed."""
    out = []
    for c in columns:
        c = c.astype(np.min_scalar_type(int(c.max(initial=0))))
        out.append(c.view(np.uint8).reshape(-1, c.itemsize).T.ravel())
        out.append(np.array([c.itemsize]))
    return zstandard.ZstdCompressor(level=1).compress(save(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    a = load(zstandard.ZstdDecompressor().decompress(blob), mapped=False)
    out = []
    for planes, width in zip(a[::2], a[1::2]):
        w = int(width[0])
        out.append(np.ascontiguousarray(planes.reshape(w, -1).T).view(f"u{w}").ravel().astype(np.int64))
    return out


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def stretch(blob: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def grouped(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The shards of a sorted column and their rows."""
    names, first = np.unique(shard, return_index=True)
    for s, a, b in zip(names, first, [*first[1:], len(shard)]):
        yield int(s), slice(int(a), int(b))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the keys' order, and which of them each key is."""
    bits = len(key).bit_length()
    if key.dtype == np.int64 and int(key.max(initial=0)) < 1 << (63 - bits):    # one number of key and place
        both = np.sort((key << bits) | np.arange(len(key)))
        order, key = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(key)
        key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return order[new], at


def by_shard(shard: np.ndarray) -> np.ndarray:
    """The order of rows by shard that keeps the order within a shard."""
    bits = len(shard).bit_length()
    return np.sort((shard << bits) | np.arange(len(shard))) & ((1 << bits) - 1)


def steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted rows, each number as the step from the one above where the numbers before it are the same."""
    new, out = np.arange(len(columns[0])) == 0, []
    for c in columns:
        step = np.diff(c, prepend=0)
        step[new] = c[new]
        out.append(step)
        new = new | (step != 0)
    return out


def unsteps(columns: list[np.ndarray]) -> list[np.ndarray]:
    new, out = np.arange(len(columns[0])) == 0, []
    for step in columns:
        total, first = np.cumsum(step), np.flatnonzero(new)
        out.append(total - np.repeat(total[first] - step[first], np.diff(first, append=len(step))))
        new = new | (step != 0)
    return out


# ---- 1. chunks and their word lists

CHUNKS = ("chunk string, shard int, n long, doc_ids array<long>, held array<boolean>, sizes array<long>, "
          "tokens binary, shards binary, words binary, counts binary")
_CHUNK_TYPES = pa.schema([
    ("chunk", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()),
    ("shards", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(start - (ends - size), size)]


def spaced(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Consecutive words, each followed by a space."""
    out = np.full(len(data) + len(size), SPACE_, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data
    return out


def chunks(docs: DataFrame, shards: int) -> DataFrame:
    """One row per chunk (``shard`` null): its documents and tokens; and one per chunk and shard:
    the distinct words, frequent ones first, and how often training documents have them."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        size = 0

        def emit():
            ids, held, per_doc, hashes, lens, data = zip(*parts)
            held, per_doc = np.concatenate(held), np.concatenate(per_doc)
            hashes, lens, data = np.concatenate(hashes), np.concatenate(lens), np.concatenate(data)
            first, at = distinct(hashes)
            rank = np.argsort(-np.bincount(at), kind="stable")
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            shard = (hashes[first[rank]] % np.uint64(shards)).astype(np.int64)
            order = by_shard(shard)
            n = np.bincount(at[np.repeat(~held, per_doc)], minlength=len(rank))[rank][order]
            first = first[rank][order]
            start = np.cumsum(lens) - lens
            name, nothing = uuid.uuid4().hex, dict.fromkeys(_CHUNK_TYPES.names)
            out = [nothing | {"chunk": name, "n": int((~held).sum()), "doc_ids": sum(ids, []),
                              "held": held.tolist(), "sizes": per_doc.tolist(), "tokens": pack(place[at]), "shards": pack(shard)}]
            for s, rows in grouped(shard[order]):
                f = first[rows]
                words = spaced(spans(data, start[f], lens[f]), lens[f])
                out.append(nothing | {"chunk": name, "shard": s, "n": len(f), "words": squeeze(words),
                                      "counts": pack(n[rows])})
            return _rows(_CHUNK_TYPES, out)

        for batch in batches:
            held = column(batch, "held").to_numpy(zero_copy_only=False).astype(bool)
            ids = column(batch, "doc_id")
            for raw in blocks(column(batch, "text"), BLOCK_BYTES):
                block = raw.lower()
                rows = slice(block.first_row, block.first_row + block.n)
                parts.append((ids[rows].to_pylist(), held[rows], block.n_words, block.word_hash,
                              block.end - block.start, block.word_bytes))
                size += len(block.data) + 1
                if size >= CHUNK_BYTES:
                    yield emit()
                    parts, size = [], 0
        if parts:
            yield emit()
    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held", held)
            .mapInArrow(cut, CHUNKS))


# ---- lists by shard: merged in parts, answered in parts

def heavy_shards(load: DataFrame) -> DataFrame:
    """``kind, shard, parts`` of the shards of ``load(kind, shard, n)`` that need several parts."""
    return (load.groupBy("kind", "shard").agg(F.ceil(F.sum("n") / PART_GRAMS).cast("int").alias("parts"))
            .filter("parts > 1"))


def in_parts(lists: DataFrame, heavy: DataFrame) -> DataFrame:
    """``lists(kind, shard, chunk, ...)`` with ``parts`` and ``part``."""
    return (attach_small(lists, heavy, ["kind", "shard"], "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("int")))


def for_parts(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows(kind, shard, ...)`` once for each part of their shard."""
    return (attach_small(rows, heavy, ["kind", "shard"], "left")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))


def merged(dealt: DataFrame, keys: list[str], merge: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """One row for the lists of each group."""
    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([{k: t[k][0].as_py() for k in ("kind", "shard")} | merge(t)], _arrow(schema))
    return dealt.groupBy(*keys).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])


# ---- 2. vocabulary

@dataclass
class Words:
    """Distinct words in order of their hash."""
    data: np.ndarray            # bytes, one word after the other
    size: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, blobs: list[bytes]) -> tuple["Words", list[np.ndarray]]:
        """The distinct words of lists, and each list's places among them."""
        raws = [stretch(b, "u1") for b in blobs]
        raw = np.concatenate(raws)
        block = Block(raw, np.array([0, len(raw)]))
        first, at = distinct(block.word_hash)
        size = block.end - block.start
        ends = np.cumsum([0] + [int((r == SPACE_).sum()) for r in raws])
        return (cls(spans(raw, block.start[first], size[first]), size[first], block.word_hash[first]),
                [at[a:b] for a, b in zip(ends, ends[1:])])


def _merge_words(t: pa.Table) -> dict:
    words, at = Words.of(t["words"].to_pylist())
    n = np.zeros(len(words.hash), np.int64)
    for a, counts in zip(at, t["counts"]):
        n[a] += unpack(counts.as_py())[0]               # a list has each word once
    return {"words": squeeze(spaced(words.data, words.size)), "counts": pack(n)}


def vocabulary(dealt: DataFrame, shards: int) -> DataFrame:
    """``kind, shard, n, total, words, counts, ids``: training words, their counts and dense ids,
    which rise as counts fall."""
    def build(t: pa.Table) -> dict:
        row = _merge_words(t)
        n, raw = unpack(row["counts"])[0], stretch(row["words"], "u1")
        block, seen = Block(raw, np.array([0, len(raw)])), n > 0
        size = (block.end - block.start)[seen]
        ids = np.empty(len(size), np.int64)
        ids[np.lexsort((block.word_hash[seen], -n[seen]))] = np.arange(len(size))
        return {"n": len(size), "total": int(n.sum()),
                "words": squeeze(spaced(spans(raw, block.start[seen], size), size)), "counts": pack(n[seen]),
                "ids": pack(ids * shards + t["shard"][0].as_py() + FIRST_ID)}
    lists = "kind int, shard int, words binary, counts binary"
    many = merged(dealt.filter("parts > 1"), ["kind", "shard", "part"], _merge_words, lists)
    one = dealt.filter("parts = 1").select("kind", "shard", "words", "counts").unionByName(many)
    return merged(one, ["kind", "shard"], build,
                  "kind int, shard int, n long, total long, words binary, counts binary, ids binary")


def letters(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each byte of words followed by a space as 2^16 * two bytes before + byte; line feeds before the first."""
    if not len(size):
        return np.zeros(0, np.int64)
    stream = spaced(data, size).astype(np.int64)
    first = np.cumsum(size + 1) - (size + 1)
    before, two = np.concatenate([[END_], stream[:-1]]), np.concatenate([[END_, END_], stream[:-2]])
    before[first], two[first] = END_, END_
    two[first + 1] = END_                               # a word has at least two places
    return (two << 16) | (before << 8) | stream


END_LETTER = np.array([(END_ << 16) | (END_ << 8) | END_])


@dataclass
class Spelling:
    """Byte triples of the vocabulary's words, interpolated with byte pairs and single bytes."""
    triple: np.ndarray          # those that occur, in order
    share: np.ndarray
    weight: np.ndarray          # of each byte pair as a context
    pair: np.ndarray            # probability after one byte

    @classmethod
    def fit(cls, triple: np.ndarray, n: np.ndarray) -> "Spelling":
        order = np.argsort(triple)
        triple, n = triple[order], n[order].astype(float)
        two = np.bincount(triple & 0xFFFF, n, 1 << 16).reshape(256, 256)
        single = (two.sum(0) + 1) / (two.sum() + 256)
        total, kinds = two.sum(1, keepdims=True), (two > 0).sum(1, keepdims=True)
        pair = (np.maximum(two - DISCOUNT, 0) + DISCOUNT * kinds * single) / np.maximum(total, 1)
        pair = np.where(total > 0, pair, single).ravel()
        total, kinds = np.bincount(triple >> 8, n, 1 << 16), np.bincount(triple >> 8, minlength=1 << 16)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        return cls(triple, (n - DISCOUNT) / total[triple >> 8], weight, pair)

    def log10(self, at: np.ndarray) -> np.ndarray:
        p = self.weight[at >> 8] * self.pair[at & 0xFFFF]
        if len(self.triple):
            k = np.minimum(np.searchsorted(self.triple, at), len(self.triple) - 1)
            p = p + np.where(self.triple[k] == at, self.share[k], 0.0)
        return np.log10(p)

    def words(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of each word."""
        if not len(size):
            return np.zeros(0)
        return np.add.reduceat(self.log10(letters(data, size)), np.cumsum(size + 1) - (size + 1))


def spelling(vocab: DataFrame, docs: int) -> Spelling:
    """Of every training word once, and the end."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in column(batch, "words"):
                raw = stretch(blob.as_py(), "u1")
                block = Block(raw, np.array([0, len(raw)]))
                u, n = np.unique(letters(block.word_bytes, block.end - block.start), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["letter", "n"])
    got = (vocab.select("words").mapInArrow(count, "letter long, n long")
           .groupBy("letter").agg(F.sum("n").alias("n")).toArrow())
    u, n = got["letter"].to_numpy(), got["n"].to_numpy()
    if docs:
        u, n = np.append(u, END_LETTER), np.append(n, 1)
    return Spelling.fit(u.astype(np.int64), n)


def token_log10(n: np.ndarray, spelt: np.ndarray, total: int, types: int) -> np.ndarray:
    """log10 probability of tokens seen ``n`` times whose spelling has log10 probability ``spelt``."""
    if not total:
        return spelt
    with np.errstate(divide="ignore"):          # unseen tokens have no share
        share = np.log10(np.maximum(n - DISCOUNT, 0) / total)
    return add10(share, np.log10(DISCOUNT * types / total) + spelt)


def add10(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of a sum; the spelling of a long word is below the smallest float."""
    return np.logaddexp(a * np.log(10), b * np.log(10)) / np.log(10)


WORD_ANSWER = "chunk string, shard int, ids binary, seen binary, spelt binary"
SPELT = 1024                # a spelling's log10 is kept in steps of 1 / SPELT


def word_answers(dealt: DataFrame, heavy: DataFrame, vocab: DataFrame, model: Spelling) -> DataFrame:
    """Id, training count and log10 of the spelling of every listed word."""
    shared = dealt.sparkSession.sparkContext.broadcast(model)
    keys = ["kind", "shard", "part"]

    def answer(vocab: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:                          # no chunk falls into this part
            return _arrow(WORD_ANSWER).empty_table()
        known = vocab.to_pylist()[0]
        words, at = Words.of(asked["words"].to_pylist())
        ids, seen = np.full(len(words.hash), UNSEEN), np.zeros(len(words.hash), np.int64)
        mine = Words.of([known["words"]])[0].hash       # in order, as the counts are
        hit = np.flatnonzero(np.isin(words.hash, mine, assume_unique=True))
        k = np.searchsorted(mine, words.hash[hit])
        ids[hit], seen[hit] = unpack(known["ids"])[0][k], unpack(known["counts"])[0][k]
        spelt = shared.value.words(words.data, words.size)
        steps = np.rint(-SPELT * spelt).astype(np.int64)
        return pa.table({
            "chunk": asked["chunk"], "shard": asked["shard"],
            "ids": pa.array([pack(ids[a]) for a in at], pa.binary()),
            "seen": pa.array([pack(seen[a]) for a in at], pa.binary()),
            "spelt": pa.array([pack(steps[a]) for a in at], pa.binary())})
    return (for_parts(vocab, heavy).groupBy(*keys).cogroup(dealt.groupBy(*keys))
            .applyInArrow(answer, WORD_ANSWER))


CODED = ("chunk string, doc_ids array<long>, held array<boolean>, sizes array<long>, tokens binary, "
         "ids binary, seen binary, spelt binary")


def coded(chunk_rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each chunk with what its words were answered.  Its tokens' numbers are now the ranks of their ids,
    so ids and counts are sorted or nearly so; unseen words come last and have neither."""
    def join(own: pa.Table, got: pa.Table) -> pa.Table:
        lists = got.take(np.argsort(got["shard"].to_numpy())).to_pylist()
        order = by_shard(unpack(own["shards"][0].as_py())[0])
        ids, seen, spelt = (np.concatenate([unpack(x[n])[0] for x in lists] or [np.zeros(0, np.int64)])
                            for n in ("ids", "seen", "spelt"))
        rank = np.lexsort((ids, ids == UNSEEN))
        known = int((ids != UNSEEN).sum())
        place = np.empty(len(order), np.int64)
        place[order[rank]] = np.arange(len(order))
        tokens = place[unpack(own["tokens"][0].as_py())[0]]
        own = own.drop_columns(["shards", "tokens"])
        for n, c in (("tokens", tokens), ("ids", steps([ids[rank[:known]]])[0]), ("seen", seen[rank[:known]]),
                     ("spelt", spelt[rank])):
            own = own.append_column(n, pa.array([pack(c)], pa.binary()))
        return own
    return chunk_rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, CODED)


# ---- 3. pairs and triples

class Chunk:
    """One row of ``CODED``."""

    def __init__(self, row: dict):
        self.name, self.doc_ids = row["chunk"], row["doc_ids"]
        self.held, self.sizes = np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        ids, self._seen, self._spelt = unsteps(unpack(row["ids"]))[0], unpack(row["seen"])[0], unpack(row["spelt"])[0]
        word_end, none = np.cumsum(self.sizes), len(self._spelt)
        self._token = np.insert(unpack(row["tokens"])[0], word_end, none)     # the end has the number after all words
        self._ids = np.concatenate([ids, np.full(none - len(ids), UNSEEN), [END]])
        # ids in their order, as small as they can be
        self._rank = np.concatenate([np.arange(len(ids)) + FIRST_ID, np.full(none - len(ids), UNSEEN), [END]])
        self.ids = self._ids[self._token]
        self.end = word_end + np.arange(len(word_end))          # where each document's end is
        self.first = self.end - self.sizes
        self.before = self._after_start(self.ids)

    def _after_start(self, ids: np.ndarray) -> np.ndarray:
        before = np.concatenate([[START], ids[:-1]])
        before[self.first] = START
        return before

    @property
    def seen(self) -> np.ndarray:
        return np.append(self._seen, np.zeros(len(self._ids) - len(self._seen), np.int64))[self._token]

    @property
    def spelt(self) -> np.ndarray:
        return np.append(self._spelt / -SPELT, 0.0)[self._token]

    def places(self, kind: int) -> np.ndarray:
        """Places of the tokens of the pairs or triples whose context has no unseen word.

        A triple needs two words or a start and a word before it."""
        known = self.before != UNSEEN
        if kind == TRIPLE:
            known[1:] &= known[:-1]
            known[self.first] = False
        return np.flatnonzero(known)

    def grams(self, kind: int, at: np.ndarray) -> list[np.ndarray]:
        """Columns of the pairs or triples of the tokens at these places."""
        cols = [self.before[at], self.ids[at]]
        return cols if kind == PAIR else [self.before[at - 1], *cols]

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs, a place in these of each distinct one in order, and which one each is."""
        at, rank = self.places(PAIR), self._rank[self._token]
        return at, *distinct(self._after_start(rank)[at] * (len(self._rank) + FIRST_ID) + rank[at])

    def distinct(self, kind: int, shards: int):
        """Distinct n-grams by (shard of their context, n-gram), their shards and training counts,
        and each token's place in that order with its token."""
        at, first, inv = self._pairs
        if kind == TRIPLE:                                  # its context is the pair one token before
            pair = np.zeros(len(self.ids), np.int64)
            pair[at] = inv
            at = self.places(TRIPLE)
            first, inv = distinct(pair[at - 1] * (len(self._rank) + FIRST_ID) + self._rank[self._token[at]])
        cols = self.grams(kind, at[first])
        train = np.repeat(~self.held, self.sizes + 1)[at]
        n = np.bincount(inv[train], minlength=len(first))
        shard = shard_of(cols, shards)
        order = by_shard(shard)                             # first was in order of the n-grams
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return [c[order] for c in cols], shard[order], n[order], place[inv], at


def turn(first: list[np.ndarray], shards: int) -> np.ndarray | int:
    """What is added to the last word of contexts, by the words before it, to get their shards."""
    key = 0
    for c in first:
        key = mix(c.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)
    return key if isinstance(key, int) else key.astype(np.int64)


def shard_of(cols: list[np.ndarray], shards: int) -> np.ndarray:
    """Shards of n-grams, by context: the remainder of its last word, turned by the word before it."""
    return (turn(cols[:-2], shards) + cols[-2]) % shards


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Chunk(row)


def load_of(code: DataFrame, shards: int) -> DataFrame:
    """``kind, shard, n``: at least as many as the n-grams that chunks list for a shard."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _each(batches):
            for kind in (PAIR, TRIPLE):
                count = np.bincount(shard_of(c.grams(kind, c.places(kind)), shards))
                s = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), kind, np.int32)), pa.array(s.astype(np.int32)), pa.array(count[s])],
                    ["kind", "shard", "n"])
    return code.mapInArrow(weigh, "kind int, shard int, n long")


def pack_grams(cols: list[np.ndarray], shards: int) -> bytes:
    """Sorted n-grams of a shard as steps; of a context's last word, what its shard does not tell."""
    return pack(*steps([*cols[:-2], cols[-2] // shards, cols[-1]]))


def unpack_grams(blob: bytes, shard: int, shards: int) -> list[np.ndarray]:
    cols = unsteps(unpack(blob))
    cols[-2] = cols[-2] * shards + (shard - turn(cols[:-2], shards)) % shards
    return cols


LISTS = "kind int, shard int, chunk string, grams binary, counts binary"


def gram_lists(code: DataFrame, shards: int) -> DataFrame:
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("chunk", pa.string()),
                           ("grams", pa.binary()), ("counts", pa.binary())])
        for c in _each(batches):
            for kind in (PAIR, TRIPLE):
                cols, shard, n, _, _ = c.distinct(kind, shards)
                yield _rows(types, [
                    {"kind": kind, "shard": s, "chunk": c.name,
                     "grams": pack_grams([x[r] for x in cols], shards), "counts": pack(n[r])}
                    for s, r in grouped(shard)])
    return code.mapInArrow(listed, LISTS)


def sort_key(cols: list[np.ndarray]) -> np.ndarray:
    """One number per n-gram that sorts as its columns do."""
    key = cols[0]
    for c in cols[1:]:
        width = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 63) // width - 1:   # too large: places among the distinct ones instead
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + c
    return key


def union(lists: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams of sorted lists, in order, and each list's places among them."""
    cols = [np.concatenate(c) for c in zip(*lists)]
    key = sort_key(cols)
    order = np.argsort(key, kind="stable")              # merges the runs that the lists are
    new = np.ones(len(order), bool)
    key = key[order]
    new[1:] = key[1:] != key[:-1]
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    ends = np.cumsum([0] + [len(x[0]) for x in lists])
    keep = order[new]
    return [c[keep] for c in cols], [at[a:b] for a, b in zip(ends, ends[1:])]


def counted(lists: list[dict], shard: int, shards: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Distinct n-grams of a shard's lists, their summed counts, and each list's places among them."""
    cols, at = union([unpack_grams(x["grams"], shard, shards) for x in lists])
    n = np.zeros(len(cols[0]), np.int64)
    for a, x in zip(at, lists):
        n[a] += unpack(x["counts"])[0]                  # a list has each n-gram once
    return cols, n, at


def used(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes numbered anew without those that do not occur, and the values of the others: what an answer
    takes does not exceed what was asked, however many shards answer a chunk."""
    found = np.flatnonzero(np.bincount(codes, minlength=len(values)))
    place = np.zeros(len(values), np.int64)
    place[found] = np.arange(len(found))
    return place[codes], values[found]


GRAM_ANSWER = ("batch int, kind int, shard int, chunks array<string>, codes array<binary>, "
               "share_values binary, weight_values binary")
_GRAM_ANSWER_TYPES = pa.schema([
    ("batch", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("chunks", pa.list_(pa.string())),
    ("codes", pa.list_(pa.binary())), ("share_values", pa.binary()), ("weight_values", pa.binary())])


def in_batches(rows: DataFrame, batches: int) -> DataFrame:
    """``rows(chunk, ...)`` with the ``batch`` of their chunk."""
    return rows.withColumn("batch", F.pmod(F.xxhash64("chunk"), F.lit(batches)).cast("int"))


def gram_answers(code: DataFrame, ids: int, shards: int, batches: int) -> DataFrame:
    """Codes of share and weight of every listed n-gram, a row for each batch of chunks, and what the codes
    stand for.

    A shard's lists are merged into its trie, which answers them.  The lists of a heavy shard are
    written and merged by part first, and each part answers its own from the trie of all."""
    spark = code.sparkSession
    heavy = written(spark, heavy_shards(load_of(code, shards)), "heavy-shards")
    lists = gram_lists(code, shards)

    def merge(t: pa.Table) -> dict:
        cols, n, _ = counted(t.select(["grams", "counts"]).to_pylist(), t["shard"][0].as_py(), shards)
        return {"grams": pack_grams([c[n > 0] for c in cols], shards), "counts": pack(n[n > 0])}
    if heavy.isEmpty():
        rows = lists.withColumn("part", F.lit(0))
    else:
        dealt = in_parts(written(spark, lists, "n-grams"), heavy)
        sums = written(spark, merged(dealt.filter("parts > 1"), ["kind", "shard", "part"], merge,
                                     "kind int, shard int, grams binary, counts binary"), "n-gram-parts")
        rows = dealt.drop("parts").unionByName(
            for_parts(sums, heavy).withColumn("chunk", F.lit(None).cast("string")))

    def answer(t: pa.Table) -> pa.Table:
        kind, shard = t["kind"][0].as_py(), t["shard"][0].as_py()
        lists = t.select(["chunk", "batch", "grams", "counts"]).to_pylist()
        asked, sums = ([x for x in lists if (x["chunk"] is None) == none] for none in (False, True))
        if not asked:                                   # no chunk falls into this part
            return _GRAM_ANSWER_TYPES.empty_table()
        cols, n, at = counted(asked, shard, shards)
        known, times = (cols, n) if not sums else counted(sums, shard, shards)[:2]
        known, times = [c[times > 0] for c in known], times[times > 0]
        values = [np.zeros(256, np.float32)] * 2
        share = weight = np.full(len(n), MISSING, np.uint16)
        if len(times):
            trie = Trie.from_bytes(Trie.build(known, times, ids, DISCOUNT).to_bytes())
            share, weight = trie.look_up(cols)
            values = [trie.share_values, trie.weight_values]
        values = [np.append(v, np.float32(none)) for v, none in zip(values, (-np.inf, 0.0))]
        order = np.argsort([x["batch"] for x in asked], kind="stable")
        out = []
        for batch, rows in grouped(np.array([asked[k]["batch"] for k in order])):
            mine = [(asked[k]["chunk"], at[k]) for k in order[rows]]
            every, ends = np.concatenate([a for _, a in mine]), np.cumsum([len(a) for _, a in mine])[:-1]
            (share_code, shares), (weight_code, weights) = used(share[every], values[0]), used(weight[every], values[1])
            out.append({"batch": batch, "kind": kind, "shard": shard, "chunks": [name for name, _ in mine],
                        "codes": [pack(*x) for x in zip(np.split(share_code, ends), np.split(weight_code, ends))],
                        "share_values": squeeze(shares), "weight_values": squeeze(weights)})
        return pa.Table.from_pylist(out, _GRAM_ANSWER_TYPES)
    return in_batches(rows, batches).groupBy("kind", "shard", "part").applyInArrow(answer, GRAM_ANSWER)


# ---- 4. scores

RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, spelling_score double, unigram_score double")


def decode(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """log10 share and weight of a chunk's n-grams; what is not there leaves all to the order below."""
    out: tuple[list, list] = ([], [])
    for a in answers:
        for k, (codes, name) in enumerate(zip(unpack(a["codes"]), ("share_values", "weight_values"))):
            out[k].append(stretch(a[name], "<f4")[codes])
    return tuple(np.concatenate(x or [np.zeros(0)]).astype(np.float64) for x in out)


def score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document's token counts, unigram base score and model score (log10)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_shards, gram_shards = (max(1, -(-size // s)) for s in (WORD_SHARD, GRAM_SHARD))
    rows, drop_rows = kept(spark, chunks(docs, word_shards), "chunks")
    chunk_rows = rows.filter(F.col("shard").isNull()).select("chunk", "n", "doc_ids", "held", "sizes", "tokens",
                                                           "shards")
    lists = (rows.filter(F.col("shard").isNotNull())
             .select(F.lit(WORD).alias("kind"), "shard", "chunk", "n", "words", "counts"))
    n_docs = chunk_rows.agg(F.sum("n")).first()[0] or 0
    heavy = written(spark, heavy_shards(lists), "heavy-lists")
    dealt = in_parts(lists.drop("n"), heavy)
    vocab, drop_vocab = kept(spark, vocabulary(dealt, word_shards), "vocabulary")
    found = vocab.agg(F.sum("n"), F.sum("total"), F.max("n")).first()
    types, train, longest = (x or 0 for x in found)
    train, types = train + n_docs, types + (n_docs > 0)
    ids = longest * word_shards + FIRST_ID + word_shards        # above every id
    model = spelling(vocab, n_docs)
    end_spelt = float(model.log10(END_LETTER)[0])
    code = written(spark, coded(chunk_rows.drop("n"), word_answers(dealt, heavy, vocab, model)), "coded")
    drop_rows()                                     # all that follows reads ``code``
    drop_vocab()
    batches = max(BATCHES, size // CHUNK_BYTES // BATCH_CHUNKS)
    got = gram_answers(code, ids, gram_shards, batches)
    scale = train + types + 1                                   # N + (V + 1)

    def add_up(own: pa.Table, got: pa.Table) -> pa.Table:
        answers: dict[str, list[dict]] = {}
        for a in sorted(got.to_pylist(), key=lambda a: (a["kind"], a["shard"])):
            for chunk, codes in zip(a["chunks"], a["codes"]):
                answers.setdefault(chunk, []).append(a | {"codes": codes})
        return pa.concat_tables(add_up_chunk(c, answers.get(c.name, [])) for c in _each(own.to_batches()))

    def add_up_chunk(c: Chunk, answers: list[dict]) -> pa.Table:
        seen, spelt = c.seen, c.spelt
        seen[c.end], spelt[c.end] = n_docs, end_spelt
        unigram = token_log10(seen, spelt, train, types)
        full = unigram.copy()
        for kind in (PAIR, TRIPLE):
            share, weight = decode([a for a in answers if a["kind"] == kind])
            _, _, _, place, at = c.distinct(kind, gram_shards)
            full[at] = add10(share[place], weight[place] + full[at])

        def of_docs(x):
            return pa.array(np.add.reduceat(x, c.first))
        return pa.table({
            "doc_id": pa.array(c.doc_ids, pa.int64()), "held_out": pa.array(c.held),
            "n_tokens": pa.array(c.sizes + 1), "n_known": of_docs((seen > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(c.sizes), train, np.int64)),
            "base_score": of_docs(np.log10((seen + 1) / scale)), "score": of_docs(full),
            "spelling_score": of_docs(spelt), "unigram_score": of_docs(unigram)})
    return in_batches(code, batches).groupBy("batch").cogroup(got.groupBy("batch")).applyInArrow(add_up, RESULT)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, table(spark, sf_dir, "documents"))
