"""Operators 11 to 13 against plain versions, on odd rows, small blocks and empty tables."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from regmesh.llm import decontamination, hard_negatives, token_alignment
from regmesh.llm.fm_index import FMIndex, suffix_array
from tests.llm.conftest import LONG, ODD, PROSE, SCHEMA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- decontamination ----

def windows_of(text, k=10):
    w = WORD.findall((text or "").translate(LOWER))
    return [tuple(w[i:i + min(k, len(w))]) for i in range(max(len(w) - k, 0) + 1)] if w else []


def plain_hits(text, items):
    """n_words, hit word numbers and item ids of one document."""
    w = WORD.findall((text or "").translate(LOWER))
    owners = {}
    for item, value in items:
        for win in windows_of(value):
            owners.setdefault(win, set()).add(item)
    hit, found = set(), set()
    for k in {len(x) for x in owners}:
        for i in range(len(w) - k + 1):
            win = tuple(w[i:i + k])
            if win in owners:
                hit.update(range(i, i + k))
                found |= owners[win] - {None}
    return len(w), sorted(hit), sorted(found)


def test_suffix_array_and_index_equal_plain_lookups():
    rng = np.random.default_rng(5)
    for trial in range(20):
        parts = [rng.integers(1, 4 + trial, rng.integers(1, 40)) for _ in range(12)]
        parts += parts[:3]                                      # copies: ties up to the separator
        text = np.concatenate([np.append(p, 0) for p in parts])
        unique = text + (text == 0).sum()
        unique[text == 0] = np.arange((text == 0).sum())
        want = sorted(range(len(text)), key=lambda i: unique[i:].tolist())
        assert suffix_array(text).tolist() == want
        index = FMIndex(text)
        for width in (1, 2, 5):
            phrases = rng.integers(1, 6 + trial, (30, width))
            for p, a, b in zip(phrases, *index.search(phrases)):
                at = [i for i in range(len(text) - width + 1) if (text[i:i + width] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == at


ITEMS = [("b", PROSE), ("a", "Fox, jumps!"), (None, "seven wizards quietly pack"), ("c", ""), ("d", None),
         ("e", "naïve café 日本語 nothing"), ("a", "word7 tail7 word8"), ("f", LONG), ("b", PROSE), ("g", "12"),
         ("10", "boxes with liquor jugs")]


@pytest.mark.parametrize("shard_words,block_bytes", [(1 << 20, 1 << 22), (50, 2000)])
def test_decontamination_equals_brute_force(spark, odd, shard_words, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = decontamination.decontaminate(odd, items, shard_words=shard_words, block_bytes=block_bytes)
    assert got.columns == [*odd.columns, "contamination"]
    rows = got.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        n, hit, ids = plain_hits(r["text"], ITEMS)
        c = r["contamination"]
        spans = [(s["first_word"], s["last_word"]) for s in c["spans"]]
        assert (c["n_words"], c["n_hit"], c["item_ids"]) == (n, len(hit), ids)
        assert [i for a, b in spans for i in range(a, b + 1)] == hit
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:]))         # merged
        words = WORD.findall((r["text"] or "").translate(LOWER))
        for s in c["spans"]:
            cut = r["text"][s["start"]:s["end"]].translate(LOWER)
            assert WORD.findall(cut) == words[s["first_word"]:s["last_word"] + 1]
    clean = {id(r): r["text"] for r in decontamination.remove_spans(got).collect()}
    assert sum("wizards quietly" in (t or "") for t in clean.values()) == 0


def test_decontamination_of_empty_tables_and_a_column_of_its_name(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    none = items.limit(0)
    assert decontamination.decontaminate(empty, items).count() == 0
    got = decontamination.decontaminate(odd.withColumn("Contamination", odd.text), none)
    assert [c.lower() for c in got.columns].count("contamination") == 1
    assert all(r["contamination"]["n_hit"] == 0 and not r["contamination"]["spans"] for r in got.collect())


def test_a_window_across_the_edge_of_a_passage_and_of_an_index(spark):
    words = [f"w{i}" for i in range(3000)]
    items = [(str(i), " ".join(words[i:i + 10])) for i in range(0, 2990, 7)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:1500]))], "doc_id int, text string")
    got = {r["doc_id"]: r["contamination"] for r in decontamination.decontaminate(
        docs, spark.createDataFrame(items, "item_id string, text string"), shard_words=300).collect()}
    assert got[1]["n_hit"] == len(plain_hits(" ".join(words), items)[1])
    assert got[1]["item_ids"] == sorted(i for i, _ in items)
    assert got[2]["item_ids"] == plain_hits(" ".join(words[:1500]), items)[2]


def test_decontamination_query_equals_its_sql(spark, smoke):
    d, _ = smoke
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    df = decontamination.op13_decontamination(spark, d)
    want = con.sql(decontamination.OP13_SQL)
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    assert (sorted(tuple(r[c] for c in order) for r in df.collect())
            == sorted(want.select(*order).fetchall()))


# ---- token alignment ----

def plain_alignment(both, text):
    """Ids and links by quadratic look-up of ends."""
    if not text:
        return None
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    ab, bb = [both.a_bytes[i] for i in a], [both.b_bytes[i] for i in b]
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return None
    ea = [sum(map(len, ab[:i + 1])) for i in range(len(ab))]
    eb = [sum(map(len, bb[:i + 1])) for i in range(len(bb))]
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ea[i] == eb[j]]
    groups, done = [], -1
    for end in sorted(set(ea) & set(eb)):
        xs = [str(a[i]) for i in range(len(a)) if done < ea[i] <= end]
        ys = [str(b[j]) for j in range(len(b)) if done < eb[j] <= end]
        groups.append(",".join(xs) + "|" + ",".join(ys))
        done = end
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


TEXTS = [t for _, t, *_ in ODD if t is None or len(t) < 2000] + [
    "<|endoftext|> </s> <unk> ▁ piece", "tabs\tand\n\nlines  and   blanks ", "Ünïcödé ǅ ​ 𝔘 ﬁ", "é" * 40,
    "\x00\x01", "a" * 500]


@pytest.mark.parametrize("table_rows", [token_alignment.TABLE_ROWS, 0])
def test_alignment_equals_brute_force(spark, table_rows):
    both = token_alignment.Aligner(*token_alignment.tokenizer_paths())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)],
                                 "doc_id int, text string, n_best string")
    got, pairs = token_alignment.align_tokens(docs, table_rows=table_rows)
    assert sorted(got.columns) == sorted(["doc_id", "text", *token_alignment.COUNTS, "groups_sha256", "n_best",
                                          "count_sum"])
    plain = [plain_alignment(both, t) for t in TEXTS]
    count = Counter(link for p in plain if p for link in p[3])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    assert {(r["a"], r["b"]): (r["n"], r["best"]) for r in pairs.collect()} == {
        k: (n, n == top[k[1]]) for k, n in count.items()}
    rows = got.collect()
    assert len(rows) == len(TEXTS) and any(p is None and t for p, t in zip(plain, TEXTS))
    for r in rows:
        p = plain[r["doc_id"]]
        want = ((p[0], p[1], p[2], len(p[3]), p[4], sum(count[x] == top[x[1]] for x in p[3]),
                 sum(count[x] for x in p[3])) if p else (0, 0, 0, 0, "", 0, 0))
        assert tuple(r[c] for c in (*token_alignment.COUNTS, "groups_sha256", "n_best", "count_sum")) == want


def test_both_encoders_of_a_agree(smoke):
    both = token_alignment.Aligner(*token_alignment.tokenizer_paths())
    texts = [t for t in smoke[1].text if t] + [t for t in TEXTS if t]
    assert both.fast is not None
    for t in texts:
        if token_alignment._latin(t):
            assert both.fast.encode_ordinary(" " + t) == both.a.encode(" " + t, add_special_tokens=False).ids


def test_tokens_without_bytes_are_linked_where_they_end():
    both = token_alignment.Aligner(*token_alignment.tokenizer_paths())
    both.a_lens[5] = both.b_lens[7] = 0
    ids_a = [i for i, n in enumerate(both.a_lens) if n == 2][:3]
    ids_b = [i for i, n in enumerate(both.b_lens) if n == 2][:3]
    a, b = [ids_a[0], 5, ids_a[1]], [ids_b[0], ids_b[1], 7]
    n, link_a, link_b, _ = both.align(a, b)
    assert n == 2 and list(zip(link_a.tolist(), link_b.tolist())) == [
        (ids_a[0], ids_b[0]), (5, ids_b[0]), (ids_a[1], ids_b[1]), (ids_a[1], 7)]


def test_alignment_of_empty_tables(spark, empty):
    got, pairs = token_alignment.align_tokens(empty)
    assert got.count() == 0 and pairs.count() == 0


# ---- hard negatives ----

def plain_negatives(rows, step=50):
    """Contract results by trying every pair; rows are (vec_id, label, integers)."""
    rows = sorted(set(rows))
    out = []
    for i, label, v in rows:
        if i % step:
            continue

        def score(w):
            return sum(x * y for x, y in zip(v, w))
        others = sorted(((-score(w), j, lab) for j, lab, w in rows if j != i))
        for s, p, _ in [o for o in others if o[2] == label][:5]:
            near = [(-t, j) for t, j, lab in others if lab != label and -50 * s <= -100 * t <= -95 * s]
            out += [(i, p, r, j, -s, t) for r, (t, j) in enumerate(near[:3], 1)]
    return sorted(out)


def test_search_of_a_block_equals_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(24):
        n, d, k = 250, int(rng.integers(1, 40)), int(rng.integers(1, 6))
        x = rng.integers(-60, 60, (n, d)) * rng.integers(1, 1 + 3 ** (trial % 3), (n, 1))
        x[rng.random(n) < 0.3] = x[0]
        x = np.ascontiguousarray(x[:, np.argsort(-(x ** 2).sum(0))])
        ids, labels, mixed = np.arange(n), rng.integers(0, 4, n), rng.permutation(n)
        index = hard_negatives.Index(ids[mixed], labels[mixed], x[mixed], k + 1)
        floor = rng.integers(-8000, 20000, 50)
        ceiling = floor + rng.integers(-10, 60000, 50)
        if trial % 4 == 0:
            floor[:], ceiling[:] = -(1 << 61), 1 << 61
        same = bool(trial % 3)
        got = {}
        for q, i, s in zip(*hard_negatives.best_rows(index, x[:50], ids[:50], labels[:50], floor, ceiling, same, k)):
            got.setdefault(int(q), []).append((-int(s), int(i)))
        scores = x[:50] @ x.T
        for q in range(50):
            fits = sorted((-int(scores[q, j]), j) for j in range(n) if j != q
                          and (labels[j] == labels[q]) == same and floor[q] <= scores[q, j] <= ceiling[q])
            assert sorted(got.get(q, [])) == fits[:k]


@pytest.mark.parametrize("block_rows", [1 << 14, 64])
def test_hard_negatives_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(9)
    data = []
    for i in range(260):
        v = rng.normal(size=6) + (i % 4)
        data.append((i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in v]))
    hot = data[100][2]
    data += [(i, 1 + i % 2, hot) for i in range(260, 400)]                   # copies
    data += [(400, 1, hot), (400, 1, hot), (450, 2, [0.0] * 6), (500, 0, hot[:3]), (550, 1, [-1.0] * 6)]
    odd = [(600, None, hot), (None, 1, hot), (650, 1, None), (700, 1, [None, 1.0]), (750, 1, [float("nan")] * 6),
           (800, 2, [float("inf")] * 6), (850, 1, []), (900, 1, [1e9] * 6)]
    df = spark.createDataFrame(data + odd, "vec_id long, label int, embedding array<double>").repartition(3)
    df = df.withColumn("query", df.label).withColumn("score", df.label)
    clean = [(i, lab, tuple(int(np.floor(256 * x)) for x in v)) for i, lab, v in data] + [(850, 1, ())]
    got = hard_negatives.hard_negatives(df, block_rows=block_rows).collect()
    order = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[c] for c in order) for r in got) == plain_negatives(clean)


def test_hard_negatives_query_equals_its_sql(spark, smoke):
    d, _ = smoke
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{d}/embeddings.parquet')")
    df = hard_negatives.op11_hard_negatives(spark, d)
    want = con.sql(hard_negatives.OP11_SQL)
    order = sorted(df.columns)
    rows = sorted(tuple(r[c] for c in order) for r in df.collect())
    assert sorted(want.columns) == order and rows and rows == sorted(want.select(*order).fetchall())


def test_hard_negatives_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.hard_negatives(none).count() == 0


def test_schema_of_the_odd_rows_is_the_shared_one():
    assert SCHEMA.startswith("doc_id long, text string")
