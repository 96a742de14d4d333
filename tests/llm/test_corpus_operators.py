"""Near-dedup of texts and vectors, components, LM scoring, and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from regmesh.llm import bagminhash, elias_fano, embedding_dedup, lm_scoring, minhash_dedup, packing
from regmesh.llm import quality_classifier, quality_rules
from regmesh.llm.components import components
from regmesh.llm.tables import attach_small
from regmesh.llm.textvec import blocks
from tests.llm.conftest import ODD


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def bag(text):
    w = words_of(text)
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_classes(docs):
    """Smallest doc_id reachable over pairs with weighted Jaccard of 0.8 or more."""
    bags = {i: bag(t) for i, t in docs}
    post = defaultdict(set)
    for i, b in bags.items():
        for s in b:
            post[s].add(i)
    parent = {i: i for i in bags}
    for a, b in sorted({(a, b) for p in post.values() for a in p for b in p if a < b}):
        both = sum((bags[a] & bags[b]).values())
        if 5 * both >= 4 * sum((bags[a] | bags[b]).values()):
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in bags}


def test_signatures_are_unbiased_and_overlap_is_exact():
    rng = np.random.default_rng(1)
    diff, high = [], []
    for _ in range(40):
        a = [f"a{rng.integers(10 ** 9)}" for _ in range(50)] * 3 + [f"b{rng.integers(10 ** 9)}" for _ in range(80)]
        b = list(a)
        for k in rng.integers(0, len(b), 6):
            b[k] = f"z{k}"
        a, b = " ".join(a), " ".join(b)
        block = next(blocks(pa.array([a, b])))
        sig = bagminhash.signatures(*bagminhash.shingles(block), 2)
        least, most = bagminhash.overlap(next(blocks(pa.array([a]))), next(blocks(pa.array([b]))))
        assert least[0] == sum((bag(a) & bag(b)).values()) and most[0] == sum((bag(a) | bag(b)).values())
        diff.append((sig[0] == sig[1]).mean() - least[0] / most[0])
        high.append(abs(diff[-1]))
    assert abs(np.mean(diff)) < 0.02 and max(high) < 0.16


def test_signature_does_not_depend_on_the_block():
    texts = [x[1] or "" for x in ODD]
    together = next(blocks(pa.array(texts), 1 << 40))
    sig = bagminhash.signatures(*bagminhash.shingles(together), together.n)
    for i, t in enumerate(texts):
        alone = next(blocks(pa.array([t])))
        assert (bagminhash.signatures(*bagminhash.shingles(alone), 1)[0] == sig[i]).all()


def test_near_duplicates_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.op1_minhash_dedup(spark, d).collect()}
    pdf = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    assert got == brute_classes(zip(pdf.doc_id, pdf.text))


def chain(n):
    """Texts that each differ from the one before in one word: only neighbours reach 0.8."""
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        out.append(" ".join(words))
        words[(i * 11) % 60] = f"n{i}"
    return out


def test_groups_that_stars_alone_would_miss(spark, monkeypatch):
    """Chains, whose ends are far apart, with blocks of two members."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 2)
    docs = [(100 + i, t) for i, t in enumerate(chain(12))] + [(5, chain(12)[11]), (200, chain(1)[0].upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(spark, df).collect()}
    assert got == brute_classes(docs)


def test_a_bucket_of_unlinked_documents_fetches_the_texts_of_near_ones_only(spark, monkeypatch):
    """Thousands of documents of one band key, two of them near: their texts alone are read."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 1000)
    n, near = 3000, chain(2)
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 16, (n, bagminhash.SIZE), dtype=np.uint16)
    sig[2500, :120] = sig[700, :120]
    bands = rng.integers(1, 1 << 60, (n, bagminhash.BANDS))
    bands[:, 3] = 77
    reps = spark.createDataFrame([(i, sig[i].tobytes(), bands[i].tolist()) for i in range(n)],
                                 "rep long, sig binary, bands array<long>")
    members = spark.createDataFrame([(77, i, n, 0) for i in range(n)], "h long, rep long, n long, leader long")
    # a pair of one component, which needs no comparison, and a larger component than all others
    comp = spark.createDataFrame([(i, 10) for i in range(10, 15)], "node long, component long")
    docs = spark.createDataFrame([(i, near[0] if i == 700 else near[1] if i == 2500 else f"text {i} " * 9)
                                  for i in range(n)], "doc_id long, text string")
    read = []
    right = minhash_dedup._texts_of
    monkeypatch.setattr(minhash_dedup, "_texts_of",
                        lambda s, d, nodes: read.append({r["doc_id"] for r in nodes.collect()}) or right(s, d, nodes))
    links = minhash_dedup.remaining_links(spark, docs, members, reps, comp)
    assert {tuple(sorted(r)) for r in links.collect()} == {(700, 2500)}
    assert read == [{700, 2500}]


def test_candidates_beyond_one_part_are_all_compared():
    """A block with several parts a side hands every near pair to one of them."""
    n = 2 * minhash_dedup.PART_MEMBERS + 7
    rng = np.random.default_rng(6)
    sig = rng.integers(0, 1 << 16, (n, bagminhash.SIZE), dtype=np.uint16)
    sig[n // 2:n // 2 * 2] = sig[:n // 2]
    bands = rng.integers(1, 1 << 60, (n, bagminhash.BANDS))
    bands[:, 0] = 5
    row = [dict(h=5, i=0, j=0, side=side, rep=i, comp=i, minor=True, sig=sig[i].tobytes(), bands=bands[i])
           for side in (0, 1) for i in range(n)]
    got = minhash_dedup._candidates(pd.DataFrame(row))
    pairs = {(a, b) for _, g in got.groupby("part") for a in g.rep[g.side == 0] for b in g.rep[g.side == 1]
             if (sig[a] == sig[b]).all() and b > a}
    assert pairs == {(i, i + n // 2) for i in range(n // 2)}
    assert got.groupby(["part", "side"]).size().max() <= minhash_dedup.PART_MEMBERS


def test_null_and_repeated_ids_and_clashing_names_in_near_dedup(spark):
    """Columns of the names that numbering uses itself come back as they were."""
    near = chain(2)
    rows = [(7, near[0], "a", "b", "c"), (7, "other words", "d", "e", "f"), (9, near[1], "g", "h", "i"),
            (None, near[0], "j", "k", "l"), (None, near[0], "j", "k", "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _doc_id string, _text string, _Number string")
    kept = minhash_dedup.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(
        map(str, spark.createDataFrame([rows[0], rows[1], *rows[3:]], df.schema).collect()))


def test_small_side_beyond_its_limit_keeps_null_rows(spark):
    big = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "c")], "k long, x string")
    small = spark.createDataFrame([(1, 5)], "k long, y int")
    for how in ("left", "left_anti", "left_semi", "inner"):
        rows = [sorted(map(str, attach_small(big, s, ["k"], how, limit).collect()))
                for s, limit in ((small if how in ("left", "inner") else small.select("k"), n) for n in (0, 9))]
        assert rows[0] == rows[1]


def test_near_duplicates_on_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["class_id"], r["kept"]) for r in minhash_dedup.near_duplicates(spark, odd).collect()]
    assert len(rows) == len(ODD)
    got = {i: (c, k) for i, c, k in rows if i is not None}
    assert got[2] == (1, False) and got[7] == (6, False) and got[10] == (9, False)
    assert got[3] == (3, True) and got[5] == (5, True)
    assert [r for r in rows if r[0] is None] == [(None, None, True)] * 2
    kept = minhash_dedup.keep_one(spark, odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(None) == 2 and not {2, 7, 10} & set(ids)
    assert minhash_dedup.near_duplicates(spark, empty).count() == 0
    assert minhash_dedup.keep_one(spark, empty).count() == 0


def test_different_texts_of_one_doc_id_are_documents_of_their_own(spark):
    near, far = chain(2), " ".join(f"z{i}" for i in range(60))
    rows = [(7, near[0]), (7, far), (7, far), (7, None), (3, far + " end"), (9, near[1]), (None, far)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash_dedup.keep_one(spark, df)
    assert kept.columns == df.columns
    # 9 is near 7's first text, 7's second text is near 3's
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(
        [(7, near[0]), (7, None), (3, far + " end"), (None, far)], df.schema).collect()))
    got = sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"])
                 for r in minhash_dedup.near_duplicates(spark, df).collect())
    assert got == sorted([("7", "7", True), ("7", "3", False), ("7", "3", False), ("7", "7", True),
                          ("3", "3", True), ("9", "7", False), ("None", "None", True)])


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(0)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 400)]
    links += [(int(a), int(b)) for a, b in rng.integers(1000, 1060, (40, 2))]
    parent = {}
    for a, b in links:
        if a is not None and a != b:
            for x in (a, b):
                parent.setdefault(x, x)
            x, y = find(parent, a), find(parent, b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in components(spark, df).collect()}
    assert got == {x: find(parent, x) for x in parent}
    assert components(spark, df.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    near = base[rng.integers(0, 40, 160)] + 0.12 * rng.standard_normal((160, 24))
    x = np.concatenate([base, near, 3 * base[:5], base[:5]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] * 24),
           (1005, [float("inf")] * 24), (None, rows[0][1]), (1006, [1.0]), (1007, [2.0]), (1008, [1.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in embedding_dedup.near_duplicates(spark, df).collect() if r["vec_id"] is not None}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    hit = u @ u.T >= 0.95
    parent = {i: i for i in range(len(x))}
    for a, b in zip(*np.nonzero(hit)):
        p, q = find(parent, a), find(parent, b)
        parent[max(p, q)] = min(p, q)
    for i in range(len(x)):
        c = find(parent, i)
        assert got[i] == (hit[i].sum() - 1, c, i == c)
    for i in (1000, 1001, 1002, 1003, 1004, 1005, 1008):
        assert got[i] == (0, i, True)
    assert got[1007] == (1, 1006, False)
    assert embedding_dedup.near_duplicates(spark, df.limit(0)).count() == 0


def test_recall_where_filters_are_planned_for_many_vectors(spark):
    """Pairs at the threshold itself among 9,000 vectors, and doubles that floats would round."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((6000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((3000, 48))
    side -= (side * x[:3000]).sum(1)[:, None] * x[:3000]
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.choice([0.9499, 0.95 - 1e-9, 0.95 + 1e-9, 0.9501, 0.97], 3000)
    y = (cosine[:, None] * x[:3000] + np.sqrt(1 - cosine ** 2)[:, None] * side) * 1e200
    all_ = np.concatenate([x, y])
    u = all_ / np.linalg.norm(all_ / np.abs(all_).max(1, keepdims=True), axis=1)[:, None] / np.abs(all_).max(1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(all_)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark, df).collect()}
    assert want.sum() > 3000 and all(got[i] <= n for i, n in enumerate(want))        # none below the threshold
    assert sum(got.values()) >= 0.98 * want.sum()


def test_list_decoding_equals_trying_every_filter():
    code = embedding_dedup.plan_filters(2000, 16)
    x = np.random.default_rng(5).standard_normal((50, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    size = code.size ** 2
    want = [[] for _ in x]
    for k, (turn, c1, c2) in enumerate(code.parts()):
        y = x @ turn
        s = (y[:, :8] @ c1.T)[:, :, None] + (y[:, 8:] @ c2.T)[:, None, :]
        for i, t in enumerate(s.reshape(len(x), -1)):
            f = np.flatnonzero(t >= code.height)
            want[i] += ([k * size + j for j in f] if len(f) else [k * size + int(t.argmax())])
    assert [f.tolist() for f in code.decode(x)] == want


def test_elias_fano_equals_plain_lookups():
    rng = np.random.default_rng(0)
    for top in (3, 100, 10 ** 6, 10 ** 11):
        x = np.sort(rng.integers(0, top, 700))
        e = elias_fano.EliasFano.of(elias_fano.load(elias_fano.save(elias_fano.EliasFano.build(x).arrays())))
        assert (e.get(np.arange(700)) == x).all()
        value = np.concatenate([x, x + 1, [0, top + 5]])
        lo, hi = rng.integers(0, 350, len(value)), rng.integers(350, 701, len(value))
        at = e.find(lo, hi, value)
        for v, i, a, b in zip(value, at, lo, hi):
            assert (a <= i < b and x[i] == v) if i >= 0 else v not in x[a:b]


def test_trie_equals_plain_lookups():
    rng = np.random.default_rng(1)
    ids = 60
    for places in (2, 3):
        grams = Counter(tuple(g) for g in (rng.integers(0, 40, (3000, places)) ** 2 // 40).tolist())
        keys = sorted(grams)
        n = np.array([grams[g] for g in keys])
        trie = elias_fano.Trie.from_bytes(
            elias_fano.Trie.build([np.array(c) for c in zip(*keys)], n, ids, 0.75).to_bytes())
        asked = sorted(set(keys) | {tuple(g) for g in rng.integers(0, ids, (500, places)).tolist()})
        share, weight = trie.look_up([np.array(c) for c in zip(*asked)])
        after = {}
        for g, c in grams.items():
            after.setdefault(g[:-1], {})[g[-1]] = c
        for g, s, w in zip(asked, share, weight):
            mine = after.get(g[:-1], {})
            assert (w == elias_fano.MISSING) == (not mine) and (s == elias_fano.MISSING) == (g[-1] not in mine)
            if mine:
                want = np.log10(0.75 * len(mine) / sum(mine.values()))
                assert abs(trie.weight_values[w] - want) < 0.1
            if g[-1] in mine:
                want = np.log10((mine[g[-1]] - 0.75) / sum(mine.values()))
                assert abs(trie.share_values[s] - want) < 0.1
        none = trie.look_up([np.zeros(0, np.int64)] * places)
        assert not len(none[0]) and not len(none[1])


def base_scores(rows):
    count, docs = Counter(), 0
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words_of(t))
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + (docs > 0)
    for i, t in rows:
        w = words_of(t)
        yield (i, len(w) + 1, sum(count[x] > 0 for x in w) + (docs > 0), n,
               sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w) + np.log10((docs + 1) / (n + v + 1)))


def test_lm_base_is_exact_and_the_model_beats_its_unigrams(spark, smoke):
    d, pdf = smoke
    got = {r["doc_id"]: r for r in lm_scoring.op10_lm_scoring(spark, d).collect()}
    for i, n, known, total, base in base_scores(list(zip(pdf.doc_id, pdf.text))):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got.values() if r["held_out"]]
    # like for like: both sides pay for the spelling of unseen words (the base score does not)
    assert sum(r["score"] for r in held) > sum(r["unigram_score"] for r in held)


def test_lm_on_odd_rows_small_chunks_and_shards(spark, odd, empty, monkeypatch):
    whole = sorted((str(r["doc_id"]), round(r["score"], 2)) for r in lm_scoring.score(spark, odd).collect())
    rows = list(lm_scoring.score(spark, odd).collect())
    want = sorted((str(i), n, k, t, round(b, 6)) for i, n, k, t, b in base_scores([x[:2] for x in ODD]))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in rows) == want
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)
    for name, value in (("BLOCK_BYTES", 500), ("WORD_SHARD", 20_000), ("GRAM_SHARD", 20_000), ("PART_GRAMS", 300)):
        monkeypatch.setattr(lm_scoring, name, value)
    again = sorted((str(r["doc_id"]), round(r["score"], 2)) for r in lm_scoring.score(spark, odd).collect())
    assert [a for a, _ in again] == [a for a, _ in whole]
    assert np.allclose([b for _, b in again], [b for _, b in whole], rtol=0.005)    # 8-bit codes
    assert lm_scoring.score(spark, empty).count() == 0


def test_lm_score_is_a_probability_and_garbled_text_costs_more(spark):
    ids = range(1, 200)
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    text = " ".join(f"the judge packed {n} boxes" for n in ("seven", "twelve", "twenty"))
    rows = [(i, text) for i in ids if zlib.crc32(str(i).encode()) % 7 != 2]
    rows += [(held[0], text), (held[1], "".join(c if c == " " else chr(97 + ord(c) * 7 % 26) for c in text)),
             (held[2], ""), (held[3], "zq" * 2000)]
    got = {r["doc_id"]: r for r in lm_scoring.score(spark, spark.createDataFrame(rows, "doc_id long, text string"))
           .collect()}
    clean, garbled, end, long = (got[i] for i in held)
    assert garbled["n_known"] == 1 and garbled["n_tokens"] == clean["n_tokens"]
    assert garbled["score"] < clean["score"] and garbled["score"] < -2 * garbled["n_tokens"]
    assert np.isfinite(long["score"]) and long["score"] < -4000       # 4,000 bytes never seen in this order
    n, types, docs = end["train_tokens"], 1 + len(set(text.split())), len(rows) - 4
    spelt = 10 ** end["spelling_score"]
    unigram = (docs - 0.75) / n + 0.75 * types / n * spelt
    assert 10 ** end["unigram_score"] == pytest.approx(unigram, rel=1e-6)
    # no text is empty and all begin alike: one token follows the start
    assert 10 ** end["score"] == pytest.approx(0.75 / docs * unigram, rel=1e-5)


def test_lm_token_probabilities_sum_to_one():
    n, spelling = np.array([5, 2, 1, 0, 0]), np.log10([0.4, 0.1, 0.2, 0.25, 0.05])
    assert (10 ** lm_scoring.token_log10(n, spelling, 8, 3)).sum() == pytest.approx(1)


def test_lm_word_order_counts_beyond_a_few_bytes(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}ation" for a in "bcdfg" for b in "aeiou" for c in "klmn"]
    order = rng.permutation(len(words))
    follows = {words[a]: words[b] for a, b in zip(order, np.roll(order, 1))}
    ids = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]

    def run(w, n):
        out = [w]
        while len(out) < n:
            out.append(follows[out[-1]])
        return out
    rows = [(i, " ".join(run(words[i % len(words)], 12))) for i in ids]
    text = run(words[5], 12)
    rows += [(held[0], " ".join(text)), (held[1], " ".join(text[::-1]))]
    got = {r["doc_id"]: r for r in lm_scoring.score(spark, spark.createDataFrame(rows, "doc_id long, text string"))
           .collect()}
    forth, back = got[held[0]], got[held[1]]
    assert forth["base_score"] == pytest.approx(back["base_score"])
    assert forth["score"] > back["score"] + 10        # reordering costs orders of magnitude
    # brute force between the bounds that the lowest order cannot leave
    seqs = [["<s>", *t.split(), "</s>"] for i, t in rows if i not in held]
    pair = Counter(p for q in seqs for p in zip(q, q[1:]))
    triple = Counter(p for q in seqs for p in zip(q, q[1:], q[2:]))

    def bounds(q):
        lo = hi = 0.0
        for i in range(1, len(q)):
            p = [0.0, 1.0]
            for counts, k in ((pair, 1), (triple, 2)):
                c = tuple(q[max(i - k, 0):i])
                after = {g: n for g, n in counts.items() if g[:-1] == c} if len(c) == k else {}
                if after:
                    total, mine = sum(after.values()), after.get((*c, q[i]), 0)
                    p = [max(mine - 0.75, 0) / total + 0.75 * len(after) / total * x for x in p]
            lo, hi = lo + np.log10(max(p[0], 1e-300)), hi + np.log10(p[1])
        return lo, hi
    lo, hi = bounds(["<s>", *text, "</s>"])
    assert lo < forth["score"] < hi and hi - lo < 2


def plain_scores(rows):
    """The model by plain counting."""
    train = [["<s>", *words_of(t), "</s>"] for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    single = Counter(w for q in train for w in q[1:])
    total, types = sum(single.values()), len(single)
    after = {}
    for q in train:
        for k in (1, 2):
            for i in range(k, len(q)):
                after.setdefault(tuple(q[i - k:i]), Counter())[q[i]] += 1
    spelt_as = {w: b"\n" if w == "</s>" else w.encode() + b" " for w in single}
    triples = Counter((s[i - 2], s[i - 1], s[i]) for s in (b"\n\n" + x for x in spelt_as.values())
                      for i in range(2, len(s)))
    follow = [{}, {}, {}]
    for (a, b, c), n in triples.items():
        for k, context in enumerate(((), (b,), (a, b))):
            follow[k].setdefault(context, Counter())[c] += n

    def byte(a, b, c):
        one = follow[0].get((), Counter())
        p = (one[c] + 1) / (sum(one.values()) + 256)
        for k, context in ((1, (b,)), (2, (a, b))):
            seen = follow[k].get(context)
            if seen:
                p = (max(seen[c] - 0.75, 0) + 0.75 * len(seen) * p) / sum(seen.values())
        return p

    def spell(w):
        s = b"\n\n" + (b"\n" if w == "</s>" else w.encode() + b" ")
        return sum(np.log10(byte(*s[i - 2:i + 1])) for i in range(2, len(s)))
    for _, t in rows:
        q, out = ["<s>", *words_of(t), "</s>"], 0.0
        for i in range(1, len(q)):
            low = spell(q[i])
            if total:
                mass = np.log10(0.75 * types / total) + low
                have = single[q[i]]
                low = np.logaddexp(np.log(10) * mass, np.log((have - 0.75) / total)) / np.log(10) if have else mass
            for k in (1, 2):
                seen = after.get(tuple(q[max(i - k, 0):i])) if i >= k else None
                if seen:
                    c = sum(seen.values())
                    rest = np.log10(0.75 * len(seen) / c) + low
                    have = seen[q[i]]
                    low = np.logaddexp(np.log(10) * rest, np.log((have - 0.75) / c)) / np.log(10) if have else rest
            out += low
        yield out


def test_lm_score_equals_plain_counting_within_quantisation(spark, smoke, odd):
    """A code is off by a 256th of the range of at most seven decades: below 0.03 a token and order."""
    def check(got, rows):
        want = sorted((str(i), len(words_of(t)) + 1, s) for (i, t), s in zip(rows, plain_scores(rows)))
        got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got.collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        for (_, n, g), (_, _, w) in zip(got, want):
            assert g == pytest.approx(w, rel=1e-4, abs=0.03 * n)
        assert sum(g[2] for g in got) == pytest.approx(sum(w[2] for w in want), rel=0.002)
    check(lm_scoring.score(spark, odd), [x[:2] for x in ODD])
    d, pdf = smoke
    check(lm_scoring.op10_lm_scoring(spark, d), list(zip(pdf.doc_id, pdf.text)))


def test_lm_keeps_every_ngram_of_a_hot_context(spark, monkeypatch):
    """One word precedes a third of all tokens; its list is merged in parts and no pair is lost."""
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(lm_scoring, "PART_GRAMS", 200)
    rows = [(i, " ".join(f"hot w{(i * 31 + k * 7) % 997} x{k}" for k in range(40))) for i in range(1, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(spark, docs).collect()}
    for (i, _), s in zip(rows, plain_scores(rows)):
        assert got[i] == pytest.approx(s, rel=0.01)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    pdf = docs.toPandas()
    model = quality_classifier.fit(docs, labels)
    good = pdf[model.score(quality_classifier.batch_features(pa.array(pdf.text))) >= 0.3]
    table_ = quality_rules.fit(docs.filter(docs.doc_id.isin(good.doc_id.tolist())), labels)
    base = quality_rules.batch_base(pa.array(good.text))
    good = good[~base["base_failed"] & (quality_rules.batch_ratio(pa.array(good.text), table_)
                                        >= quality_rules.THRESHOLD)]
    classes = brute_classes(list(zip(good.doc_id, good.text)))
    left = {i for i, c in classes.items() if i == c}
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in rows} == left
    assert 0 < len(left) < len(pdf)
    from tests.llm.test_text_operators import check_packing
    check_packing(rows, packing.CAPACITY)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty):
    d = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() >= docs.count()
