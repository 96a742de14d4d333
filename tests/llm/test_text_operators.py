"""Quality rules and classifier, language id, packing, SentencePiece, sharding, chat formatting."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regmesh.llm import (chat_format, language_id, packing, quality_classifier, quality_rules,
                         sentence_pieces, sharding)
from regmesh.llm.docstats import FEATURES, features
from regmesh.llm.textvec import blocks
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n, cover = Counter(wins), [0] * len(words)
    for i, w in enumerate(wins):
        if n[w] > 1:
            cover[i:i + 8] = [1] * 8
    rep = sum(cover)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep,
            len(words) < 20 or 100 * rep > 30 * len(words))


COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def key(x):
    return tuple((v is None, str(v)) for v in x)


def test_base_rules_equal_brute_force(spark, smoke, odd):
    d, pdf = smoke
    got = {r["doc_id"]: r for r in quality_rules.op3_quality_rules(spark, d).collect()}
    assert len(got) == len(pdf)
    for i, text in zip(pdf.doc_id, pdf.text):
        assert tuple(got[i][c] for c in COLS) == base_of(text)
        assert got[i]["kept"] in (True, False) and not (got[i]["kept"] and got[i]["base_failed"])
    rows = quality_rules.rate(odd, np.zeros(quality_rules.BUCKETS)).collect()
    assert sorted([key((r["doc_id"], *(r[c] for c in COLS))) for r in rows]) == sorted(
        [key((x[0], *base_of(x[1]))) for x in ODD])


def test_ratio_counts_equal_brute_force(spark, odd):
    marked = odd.select("text", (F.col("doc_id") == 1).alias("t")).select(
        "text", F.coalesce("t", F.lit(False)).alias("trusted"))
    got = {r["bucket"]: (r["raw"], r["target"]) for r in quality_rules.counts(marked).collect()}
    raw, target = Counter(), Counter()
    for x in ODD:
        b = (x[1] or "").encode()
        for block in blocks(pa.array([x[1] or ""])):
            grams = quality_rules.gram_buckets(block)[0]
            assert len(grams) == max(0, len(b) - 3)
            raw.update(grams.tolist())
            if x[0] == 1:
                target.update(grams.tolist())
    assert got == {k: (raw[k], target[k]) for k in raw}


def test_quality_operators_on_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table_ = quality_rules.fit(odd, labels)
    assert not table_.any()
    assert quality_rules.rate(empty, table_).count() == 0
    model = quality_classifier.fit(odd, labels)
    assert {r["score"] for r in quality_classifier.score(odd, model).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0
    assert quality_classifier.keep_good(odd, model).columns == odd.columns


def test_classifier_sums_equal_numpy_and_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    pdf = docs.toPandas().merge(labels.toPandas(), on="doc_id")
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in pdf.doc_id])
    x = np.vstack([features(b) for b in blocks(pa.array(pdf.text))])
    y = pdf.quality.to_numpy()
    for k in (0, 1):
        assert np.allclose(model.classes[k][0], x[(fold != 0) & (y == k)].mean(0))
    got = quality_classifier.op9_quality_classifier(spark, d).toPandas().merge(pdf, on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == (np.array([zlib.crc32(str(i).encode()) % 5 for i in held.doc_id]) == 0)).all()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_features_are_finite():
    x = np.vstack([features(b) for b in blocks(pa.array([r[1] for r in ODD]))])
    assert x.shape == (len(ODD), len(FEATURES)) and np.isfinite(x).all()


def test_language_held_out_accuracy_and_odd_texts(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    got = language_id.op5_language_id(spark, d).toPandas().merge(
        spark.read.parquet(f"{d}/documents.parquet").toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() >= 0.98
    assert got.score.between(0, 1).all()
    model = language_id.fit(odd.select("lang", "text"))
    rows = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(odd, model).collect()]
    assert len(rows) == len(ODD)
    got = dict(r for r in rows if r[0])
    assert got[3] == got[4] == got[5] == got[12] == "und" and got[14] == "de" and got[2] == "en"
    none = language_id.fit(empty.select("lang", "text"))
    assert {r["lang_pred"] for r in language_id.predict(odd, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_language_filters_grow_with_the_n_grams(spark):
    rng = np.random.default_rng(0)
    rows = [(lang, " ".join("".join(chr(a + x) for x in rng.integers(0, 26, 8)) for _ in range(600)))
            for lang, a in (("low", 97), ("greek", 0x3B1))]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.fit(docs, rows=1 << 10)
    size = len(model.masks[0])
    assert size > 1 << 10 and size & (size - 1) == 0
    assert model.false_rate().max() < 1.5 * language_id.FALSE_RATE
    assert language_id.rows_for(20_000, language_id.ROWS) == language_id.ROWS
    # no corpus gives a language more n-grams than its least rate allows, and their table is bounded
    assert language_id.rows_for(round(1 / language_id.LEAST_RATE), language_id.ROWS) == 1 << 24
    # at a least rate of 1/1000 no random n-gram is frequent enough, the spaced common word still is
    common = spark.createDataFrame([("low", rows[0][1] + " zzz" * 600)], "lang string, text string")
    few = language_id.fit(common, rows=1 << 10, least_rate=1e-3)
    assert len(few.masks[0]) == 1 << 10 and 0 < few.masks[0].astype(bool).sum() <= 3 * 8


def plain_languages(train, texts, share, least):
    """Shares of n-grams that each language contains, by sets in place of filters."""
    def spaced(t):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").lower().encode())
        s = b" " + b"".join(w + b" " for w in words) if words else b""
        return [s[i:i + 4] for i in range(len(s) - 3)]
    counts = {}
    for lang, t in train:
        counts.setdefault(lang, Counter()).update(spaced(t))
    total = {x: c.total() for x, c in counts.items()}
    rate = {x: {g: n / total[x] for g, n in c.items()} for x, c in counts.items()}
    top = {}
    for r in rate.values():
        for g, v in r.items():
            top[g] = max(v, top.get(g, 0))
    has = {x: {g for g, v in r.items() if v >= share * top[g] and v >= least} for x, r in rate.items()}
    langs = sorted(total, key=lambda x: (-total[x], x))
    return langs, [[sum(g in has[x] for g in gs) / max(len(gs), 1) for x in langs] for gs in map(spaced, texts)]


@pytest.mark.parametrize("least", [language_id.LEAST_RATE, 2e-4])
def test_language_counts_and_predictions_equal_a_plain_version(spark, smoke, least):
    d, pdf = smoke
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language_id.fit(docs.select("lang", "text"), least_rate=least)
    train = [(x, t) for x, t in zip(pdf.lang, pdf.text) if x is not None]
    langs, want = plain_languages(train, list(pdf.text), language_id.SHARE, least)
    assert model.langs == langs
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for i, t, shares in zip(pdf.doc_id, pdf.text, want):
        if not any(c.isalpha() for c in t or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        first, second = sorted(shares)[-1], sorted(shares)[-2]
        assert got[i]["score"] == pytest.approx(first / max(sum(shares), 1e-12), abs=0.02)
        if first - second > 0.01:
            assert got[i]["lang_pred"] == langs[int(np.argmax(shares))]


def test_language_masks_equal_brute_force():
    g = np.arange(500, dtype=np.uint64) * np.uint64(7919)
    rows = 1 << 12
    table_ = np.zeros(rows, np.int64)
    for i in range(2):
        for p in language_id._positions(g[i::2], rows):
            table_[p] |= 1 << i
    share = language_id.Filters(["a", "b"], [table_]).shares(np.concatenate([g[::2], g[1::2]]),
                                                          np.array([0, 250, 500]))
    assert share[0, 0] == share[1, 1] == 1 and share[0, 1] < 0.1 and share[1, 0] < 0.1


def check_packing(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_packing_equals_library_ids_and_fills_sequences(spark, smoke, odd, empty):
    from tokenizers import Tokenizer
    d, pdf = smoke
    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.op6_best_fit_packing(spark, d).collect()
    want = {}
    for i, text in zip(pdf.doc_id, pdf.text):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k:k + 4096]
            want[i, k // 4096] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    total = sum(x[1] for x in want.values())
    assert check_packing(rows, 4096) <= -(-total // 4096) + 1
    some = packing.pack(spark, odd, capacity=64, with_ids=True).collect()
    check_packing(some, 64)
    assert all(len(r["ids"]) == r["length"] for r in some)
    assert sum(r["length"] == 1 and r["doc_id"] in (3, 4, 5) for r in some) == 3
    assert packing.pack(spark, empty).count() == 0


def test_new_words_equal_the_library():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in [*range(33, 127), *range(161, 256), 0, 1, 0x85, 0xA0, 0x130, 0x3A3, 0x1F600, 0x301]]
    words = ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(4000)]
    words += ["".join(rng.choice(list("abst'SrRe1dl²ª"), rng.integers(1, 9))) for _ in range(4000)]
    words += ["a" * 3000, "<|endoftext|>x", "x<|startoftext|>", "don't", "DON'T", "it's1'Ll", "é", "\x00"]
    lens, ids = encoder.new_words(words)
    want = [x.ids for x in encoder.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert encoder.ranked is not None
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == want
    assert [x.tolist() for x in encoder.new_words([])] == [[], []]


def test_null_ids_are_ranked_in_groups_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_TARGET", 500)
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    placed = packing.pack(spark, docs).cache()
    assert placed.count() == 6000 and placed.select("sequence_id", "offset").distinct().count() == 6000
    cut = packing.written(spark, packing.pieces(docs).withColumn("place", F.monotonically_increasing_id()), "cut")
    groups = cut.groupBy(F.pmod(F.xxhash64("place"), F.lit(12))).count().agg(F.max("count")).first()[0]
    assert groups < 650


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(3)
    for _ in range(20):
        hist = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 12), rng.integers(1, 40, 12))}
        rows = packing.plan(hist, 64)
        room, ranks = Counter(), {k: [] for k in hist}
        spans = {}
        for length, rank, n, seq, off in rows:
            ranks[length] += range(rank, rank + n)
            for i in range(seq, seq + n):
                room[i] += length
                spans.setdefault(i, []).append((off, length))
        assert all(sorted(r) == list(range(hist[k])) for k, r in ranks.items())
        assert max(room.values()) <= 64 and sorted(room) == list(range(len(room)))
        for s in spans.values():
            assert sorted(o for o, _ in s) == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))]
        left = []                                   # best fit, one piece at a time
        for length in sorted(hist, reverse=True):
            for _ in range(hist[length]):
                fits = [(x, i) for i, x in enumerate(left) if x >= length]
                if fits:
                    left[min(fits)[1]] -= length
                else:
                    left.append(64 - length)
        assert len(room) == len(left)


TEXTS = [x[1] or "" for x in ODD[:9]] + ["▁mark ▁", "x" * 600, "the" * 400 + "zz" * 30, "a  b   c ", "\x00a",
                                        "<s> </s> <unk> <0x41>", "      " * 9]


def test_sentence_pieces_equal_the_library_and_come_back(spark, smoke, odd, empty):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    _, pdf = smoke
    texts = TEXTS + list(pdf.text[:60])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = sentence_pieces.encode(df)
    assert {r["doc_id"]: r["ids"] for r in enc.collect()} == dict(enumerate(lib.encode(texts)))
    back = {r["doc_id"]: r["text"] for r in sentence_pieces.decode(enc).collect()}
    assert back == {i: t.replace("▁", " ") for i, t in enumerate(texts)}
    rows = sentence_pieces.round_trip(odd).collect()
    assert len(rows) == len(ODD) and all(r["restored"] for r in rows)
    assert sentence_pieces.round_trip(empty).count() == 0


def test_lookup_table_is_even_and_stable(spark, odd, empty):
    names = sharding.shard_names(7)
    owner = sharding.lookup_table(names, 997)
    n = np.bincount(owner)
    assert n.max() - n.min() <= 1
    # brute force: the turns, one by one
    want, order = {}, []
    for name in names:
        h = hashlib.sha256(name.encode()).digest()
        a, s = int.from_bytes(h[:8], "big") % 997, int.from_bytes(h[8:16], "big") % 996 + 1
        order.append([(a + j * s) % 997 for j in range(997)])
    while len(want) < 997:
        for i, o in enumerate(order):
            free = next((x for x in o if x not in want), None)
            if free is not None:
                want[free] = i
    assert [want[i] for i in range(997)] == owner.tolist()
    fewer = sharding.lookup_table(names[:-1], 997)
    moved = ((owner != fewer) & (owner != 6)).mean()
    assert moved < 0.15
    rows = sharding.place(spark, odd, ["doc_id"], names, 997).collect()
    assert len(rows) == len(ODD) and {r["shard"] for r in rows} <= set(names)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.place(spark, empty, ["doc_id"], names, 997).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_written_shards_hold_every_row(spark, odd):
    from tests.util import local_dir
    path = local_dir(spark, "shards")
    placed = sharding.place(spark, odd, ["doc_id"], sharding.shard_names(3), 97)
    sharding.write_shards(placed, path, rows_per_file=4)
    assert spark.read.parquet(path).count() == len(ODD)


def test_sharding_query_writes_whole_rows_and_reads_them_back(spark, odd, empty, monkeypatch):
    from pathlib import Path
    monkeypatch.setattr(sharding, "table", lambda *a: odd)
    monkeypatch.setattr(sharding, "DOCS_PER_FILE", 4, raising=False)
    got = sharding.op4_sharding(spark, "")
    files = got.inputFiles()
    assert files and all("/shard=shard-" in f for f in files)
    path = str(Path(files[0].removeprefix("file://")).parent.parent)
    key = lambda r: tuple(map(str, r))
    placed = sharding.place(spark, odd, ["doc_id"], sharding.shard_names())
    assert sorted(map(key, spark.read.parquet(path).select(placed.columns).collect())) == sorted(
        map(key, placed.collect()))
    assert sorted(map(key, got.collect())) == sorted(map(key, placed.select("doc_id", "slot", "shard").collect()))
    monkeypatch.setattr(sharding, "table", lambda *a: empty)
    assert sharding.op4_sharding(spark, "").count() == 0


def test_chat_query_equals_its_sql(spark):
    import duckdb
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    rel = con.sql(chat_format.OP2_SQL)
    df = chat_format.op2_chat_formatting(spark, d).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_chat_loss_is_read_from_under_the_mask(spark, monkeypatch):
    rows = [(1, 0, "user", "Hi 🎉"), (1, 1, "assistant", "</s> a\\b 🎉"), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat_format, "table", lambda *a: df)

    def digest():
        got = {r["conv_id"]: r for r in chat_format.op2_chat_formatting(spark, "").collect()}
        return got[1]["loss_chars"], got[1]["loss_sha256"]
    text = "</s> a\\b 🎉"
    assert digest() == (len(text), hashlib.sha256(text.encode()).hexdigest())
    right = chat_format.format_chats
    monkeypatch.setattr(chat_format, "format_chats", lambda t: right(t).withColumn("loss_mask", F.transform(
        "loss_mask", lambda m: F.struct((m["start"] + 1).alias("start"), m["length"].alias("length"),
                                        m["loss"].alias("loss")))))
    assert digest()[1] != hashlib.sha256(text.encode()).hexdigest()      # wrong spans show


def test_chat_texts_come_back_and_parts_become_placeholders(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<<SYS>> <</SYS>>", None, "", "a\nb", "<s", "<\\|x", "🎉[INST]"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    rows += [(2, 0, None, "hi"), (2, 0, None, "hi"), (None, 3, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(F.col("text"))))
    got = {r["conv_id"]: r for r in chats.withColumn("back", chat_format.read_back(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [(r[2], r[3] or "") for r in rows[:10]]
    assert [t["text"] for t in got[2]["back"]] == ["hi", "hi"] and got[None]["back"][0]["text"] == "x"
    r = got[1]
    for m, (_, _, role, text) in zip(r["loss_mask"], rows):
        assert m["loss"] == (role == "assistant")
        inner = r["formatted"][m["start"]:m["start"] + m["length"]]
        assert re.sub(r"(?s)\\(.)", r"\1", inner) == (text or "")
    for s in chat_format.CONTROL[1:]:
        assert s not in r["formatted"][3:-4]
    part = chat_format.PART
    mixed = spark.sql(f"""SELECT 5L conv_id, 0L turn, 'user' role, cast(array(
        named_struct('type','text','text','see <|image|>','uri',null,'width',null,'height',null,'seconds',null,'pages',null),
        named_struct('type','image','text',null,'uri','a.png','width',57,'height',28,'seconds',null,'pages',null),
        named_struct('type','audio','text',null,'uri','b.wav','width',null,'height',null,'seconds',2.5,'pages',null),
        null,
        named_struct('type','document','text',null,'uri','c.pdf','width',null,'height',null,'seconds',null,'pages',3))
        as array<{part}>) parts""")
    r = chat_format.format_chats(mixed).first()
    assert r["formatted"] == "<s><|turn|>user<|body|>see <\\|image|><|image|><|audio|><|document|><|end|></s>"
    assert [(a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 2400)]
    assert r["n_tokens"] == 6 + 3 + 63 + 2400
    assert chat_format.format_chats(mixed.limit(0)).count() == 0
