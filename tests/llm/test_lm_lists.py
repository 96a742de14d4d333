"""What op10 writes and shuffles: lists without what their shard tells, answers with the values they use,
nothing left behind; and the numbers of a chunk's n-grams."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from regmesh.llm import elias_fano, lm_scoring
from regmesh.session import ensure_checkpoint_dir


@pytest.mark.parametrize("places", [2, 3])
def test_lists_come_back_and_leave_out_what_the_shard_tells(places):
    rng, shards = np.random.default_rng(places), 64
    grams = sorted({tuple(g) for g in (rng.random((20_000, places)) ** 3 * 1e6).astype(int).tolist()})
    cols = [np.array(c) for c in zip(*grams)]
    shard = lm_scoring.shard_of(cols, shards)
    assert np.bincount(shard, minlength=shards).min() > 0
    packed = plain = 0
    for s in range(shards):
        mine = [c[shard == s] for c in cols]
        blob = lm_scoring.pack_grams(mine, shards)
        assert all((a == b).all() for a, b in zip(lm_scoring.unpack_grams(blob, s, shards), mine))
        packed += len(blob)
        plain += len(lm_scoring.pack(np.diff(mine[0], prepend=0), *mine[1:]))
    assert packed < 0.95 * plain
    none = [np.zeros(0, np.int64)] * places
    assert not any(len(c) for c in lm_scoring.unpack_grams(lm_scoring.pack_grams(none, shards), 3, shards))


def test_an_answer_takes_no_more_than_was_asked():
    values = np.append(np.linspace(-7, 0, 256), -np.inf).astype(np.float32)
    codes = np.array([9, 256, 9, 200], np.uint16)
    code, mine = lm_scoring.used(codes, values)
    assert (mine[code] == values[codes]).all() and len(mine) == 3


@pytest.mark.parametrize("key", [
    np.array([5, 3, 5, 0, 3, 3]), np.array([1 << 62, 7, 1 << 62, 1 << 61]), np.zeros(0, np.int64),
    np.array([1 << 63, 2, 1 << 63], np.uint64)])
def test_distinct_equals_np_unique(key):
    first, at = lm_scoring.distinct(key)
    want, inverse = np.unique(key, return_inverse=True)
    assert (key[first] == want).all() and (at == inverse).all()


def chunk_row(texts, held, vocab):
    """A row of CODED from words by plain means."""
    words = sorted({w for t in texts for w in t}, key=lambda w: (w not in vocab, vocab.get(w, 0), w))
    ids = np.array([vocab[w] for w in words if w in vocab], np.int64)
    return {"chunk": "c", "doc_ids": list(range(len(texts))), "held": held, "sizes": [len(t) for t in texts],
            "tokens": lm_scoring.pack(np.array([words.index(w) for t in texts for w in t], np.int64)),
            "ids": lm_scoring.pack(*lm_scoring.steps([ids])), "seen": lm_scoring.pack(np.ones(len(ids), np.int64)),
            "spelt": lm_scoring.pack(np.zeros(len(words), np.int64))}


def test_a_chunk_lists_what_plain_counting_finds():
    rng, shards = np.random.default_rng(4), 5
    vocab = {f"w{k}": 3 + 7 * k for k in range(30)}             # w30 and on are unseen
    texts = [[f"w{k}" for k in rng.integers(0, 36, n)] for n in (40, 0, 1, 2, 90, 0)]
    held = [False, False, True, False, True, False]
    c = lm_scoring.Chunk(chunk_row(texts, held, vocab))
    for kind in (lm_scoring.PAIR, lm_scoring.TRIPLE):
        want, asked = Counter(), []
        for t, h in zip(texts, held):
            q = [lm_scoring.START, *(vocab.get(w, lm_scoring.UNSEEN) for w in t), lm_scoring.END]
            for i in range(kind, len(q)):
                g = tuple(q[i - kind:i + 1])
                if lm_scoring.UNSEEN not in g[:-1]:
                    want[g] += not h
                    asked.append(g)
        cols, shard, n, place, at = c.distinct(kind, shards)
        got = list(zip(*(x.tolist() for x in cols)))
        assert dict(zip(got, n.tolist())) == dict(want) and len(got) == len(want)
        assert [got[p] for p in place] == asked
        assert (shard == lm_scoring.shard_of(cols, shards)).all()
        assert got == [g for _, g in sorted(zip(shard.tolist(), got))]
        load = np.bincount(lm_scoring.shard_of(c.grams(kind, c.places(kind)), shards), minlength=shards)
        assert (load >= np.bincount(shard, minlength=shards)).all()


def test_long_runs_of_one_high_part_are_found():
    x = np.concatenate([np.zeros(500, np.int64), np.arange(300), np.arange(300) * 10 ** 6 + 400])
    e = elias_fano.EliasFano.of(elias_fano.load(elias_fano.save(elias_fano.EliasFano.build(np.sort(x)).arrays())))
    x = np.sort(x)
    assert (e.get(np.arange(len(x))) == x).all()
    at = e.find(np.zeros(len(x), np.int64), np.full(len(x), len(x)), x)
    assert (x[at] == x).all()


def test_chunks_and_vocabulary_are_deleted_and_the_result_can_be_read_twice(spark):
    def left():
        folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
        return {p.name for name in ("chunks", "vocabulary") for p in folder.glob(f"{name}-*")}
    before, bases = left(), {b.name for b in spark.catalog.listDatabases()}
    rows = [(i, f"the judge packed box {i % 5}") for i in range(1, 40)]
    got = lm_scoring.score(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    once, again = (sorted((r["doc_id"], r["score"]) for r in got.collect()) for _ in range(2))
    assert once == again and len(once) == len(rows)
    assert left() == before and {b.name for b in spark.catalog.listDatabases()} == bases


def test_batches_of_chunks_score_as_single_chunks_do(spark, monkeypatch):
    """However many chunks there are, a shard answers a batch of them with one list of values."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(1, 40, 60) ** 2 // 40)) for i in range(1, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for name, value in (("CHUNK_BYTES", 1500), ("BLOCK_BYTES", 500), ("GRAM_SHARD", 8000)):
        monkeypatch.setattr(lm_scoring, name, value)
    answered, plain = [], lm_scoring.gram_answers

    def watched(code, ids, shards, batches):
        got = plain(code, ids, shards, batches)
        answered.append((code.count(), shards, got.count()))
        return got
    monkeypatch.setattr(lm_scoring, "gram_answers", watched)
    scores = []
    for batches in (1 << 20, 1):
        monkeypatch.setattr(lm_scoring, "BATCHES", batches)
        monkeypatch.setattr(lm_scoring, "BATCH_CHUNKS", 1 << 20 if batches == 1 else 1)
        scores.append({r["doc_id"]: r["score"] for r in lm_scoring.score(spark, docs).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-12) and len(scores[0]) == len(rows)
    (chunks, shards, single), (_, _, batched) = answered
    assert chunks > 10 and shards > 1 and single > 5 * batched and batched <= 2 * shards
