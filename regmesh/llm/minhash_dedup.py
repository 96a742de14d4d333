"""MinHash near-dedup: BagMinHash signatures, banding, exact check of the multiset overlap.

1. One pass over the texts makes each document's signature, its band keys and
   a 128-bit key of its word sequence; these narrow rows are written once.
2. Documents of equal word sequences form a class at once; the one with the
   smallest ``doc_id`` stands for it from here on, so thousands of copies
   cost one row each and no pairs.
3. Bands: class representatives that share a band key meet in a bucket.  Each
   is paired with the bucket's smallest member (a star, linear in the bucket)
   and the pairs' texts are compared exactly: five-word shingles as
   multisets, sum(min) / sum(max) >= 0.8.
4. Members whose star pair failed may still match another member.  Where a
   bucket now spans several components, its members outside the largest of
   them are compared by signature with all its members, in blocks of bounded
   size dealt over the cluster, in the first bucket that a pair shares.  These
   rows are signatures and band keys, no texts; what leaves a block are the
   members with an estimate within four standard errors of the threshold, cut
   into parts.  Only those fetch their texts and are compared exactly, until
   the member is linked to the other's component.  Members of one component
   need no comparison.
5. Components of all links: one class each, named by its smallest ``doc_id``.

So every pair of representatives that shares a band key is either compared
or already connected; a pair of similarity 0.8 shares one with probability
1 - (1 - 0.8^5)^25 > 0.9999.  No bucket is cut and nothing is gathered on
the driver.

Defined results: null and white-space texts and rows with a null ``doc_id``
match nothing and are kept; a text of one to four words matches only equal
word sequences; A-Z match a-z; rows that repeat a ``doc_id`` and its text are
one document; rows of one ``doc_id`` with different texts are documents of
their own, numbered in order of ``doc_id``; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from .bagminhash import BANDS, SIZE, band_keys, overlap, shingles, signatures, weigh
from .components import components
from .tables import SMALL_ROWS, attach_small, table, written
from .textvec import blocks, column, hash_spans, mix

THRESHOLD_PERCENT = 80
MARGIN = 0.14                   # four standard errors of an estimate of 0.8 from SIZE components
SKETCH_BYTES = 1 << 20          # text sketched at a time
PAIR_TARGET = 2_000
BLOCK_MEMBERS, PART_MEMBERS = 4096, 512     # of a side: compared by signature, by text

SKETCH = "doc_id long, k1 long, k2 long, bands array<long>, sig binary"
CANDIDATE = "h long, i int, j int, part int, side int, rep long, comp long, minor boolean"
CANDIDATE_COLUMNS = [c.split()[0] for c in CANDIDATE.split(", ")]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for raw in blocks(column(batch, "text"), SKETCH_BYTES):
            block = raw.lower()
            some = np.flatnonzero(block.n_words > 0)
            if not len(some):
                continue
            sig = signatures(*shingles(block), block.n)[some]
            # the word sequence as two hashes of its word hashes
            words = block.word_hash
            per = block.n_words[some]
            k1 = hash_spans(words.view(np.uint8), per * 8)
            k2 = hash_spans(mix(words).view(np.uint8), per * 8)
            small = (sig >> np.uint64(48)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(some + raw.first_row)), pa.array(k1.view(np.int64)),
                pa.array(k2.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS),
                                         pa.array(band_keys(sig).view(np.int64).ravel())),
                pa.array([r.tobytes() for r in small], pa.binary())],
                ["doc_id", "k1", "k2", "bands", "sig"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = column(batch, "a"), column(batch, "b")
        sizes = (pa.compute.binary_length(column(batch, "text_a")).to_numpy()
                 + pa.compute.binary_length(column(batch, "text_b")).to_numpy())
        part = np.cumsum(sizes) // SKETCH_BYTES          # rows compared at a time
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(cuts, [*cuts[1:], batch.num_rows]):
            side = [next(blocks(column(batch, c)[lo:hi], 1 << 62)).lower() for c in ("text_a", "text_b")]
            least, most = overlap(*side)
            hit = np.flatnonzero((100 * least >= THRESHOLD_PERCENT * most) & (least > 0)) + lo
            yield pa.RecordBatch.from_arrays([a.take(pa.array(hit)), b.take(pa.array(hit))], ["a", "b"])


def verify(spark: SparkSession, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of documents whose multisets overlap by the threshold, written."""
    texts = _texts_of(spark, docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    heavy = [hot_keys(pairs.groupBy(k).agg(F.count(F.lit(1)).alias("_w")), [k], "_w", PAIR_TARGET)
             for k in ("a", "b")]
    j = salted_join(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")),
                    ["a"], "inner", heavy[0], row_id=["a", "b"])
    j = salted_join(j, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")),
                    ["b"], "inner", heavy[1], row_id=["a", "b"])
    return written(spark, j.mapInArrow(_verify, "a long, b long"), "links-found")


def _texts_of(spark: SparkSession, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, text`` of the given documents, written."""
    return written(spark, attach_small(docs, written(spark, nodes, "nodes"), ["doc_id"], "left_semi")
                   .groupBy("doc_id").agg(F.min("text").alias("text")), "texts")


def _near(left: pd.DataFrame, right: pd.DataFrame, here: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``left``, the rows of ``right`` in another component that are near by
    signature and share no bucket before ``here``, nearest first."""
    if not len(left) or not len(right):
        return
    sl, sr = (np.frombuffer(b"".join(x.sig), np.uint16).reshape(len(x), SIZE) for x in (left, right))
    kl, kr = (np.stack(list(x.bands)) for x in (left, right))
    rl, rr, cl, cr = left.rep.to_numpy(), right.rep.to_numpy(), left.comp.to_numpy(), right.comp.to_numpy()
    minor = right.minor.to_numpy()
    least = (THRESHOLD_PERCENT / 100 - MARGIN) * SIZE
    for i in range(len(rl)):
        near = (sr == sl[i]).sum(1)
        hit = np.flatnonzero((near >= least) & (cr != cl[i]) & (~minor | (rr > rl[i])))
        shared = kr[hit] == kl[i]
        hit = hit[kl[i][shared.argmax(1)] == here]
        if len(hit):
            yield i, hit[np.argsort(-near[hit], kind="stable")]


def _candidates(rows: pd.DataFrame) -> pd.DataFrame:
    """The members of a block that are near another, once for each part in which they are."""
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    parts = -(-len(right) // PART_MEMBERS)
    found: defaultdict[int, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    for i, hit in _near(left, right, rows.h.iloc[0]):
        of = hit // PART_MEMBERS
        for p in np.unique(of):
            mine, others = found[i // PART_MEMBERS * parts + int(p)]
            mine.add(i)
            others.update(hit[of == p].tolist())
    picked = [frame.iloc[sorted(at)].assign(part=part) for part, sides in found.items()
              for frame, at in zip((left, right), sides)]
    return pd.concat(picked or [rows.iloc[:0].assign(part=0)])[CANDIDATE_COLUMNS]


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one part of a block: pairs near by signature, checked exactly.

    A pair is not looked at once its left document is linked to the right one's component."""
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    rl, rr, cr = left.rep.to_numpy(), right.rep.to_numpy(), right.comp.to_numpy()
    tl, tr = left.text.to_numpy(), right.text.to_numpy()
    sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bag(rep: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if rep not in sets:
            h, _, w = weigh(*shingles(next(blocks(pa.array([text]), 1 << 62)).lower()))
            order = np.argsort(h)
            sets[rep] = h[order], w[order]
        return sets[rep]

    out: list[tuple[int, int]] = []
    for i, hit in _near(left, right, rows.h.iloc[0]):
        linked: set[int] = set()
        for j in hit:
            if cr[j] in linked:
                continue
            (ha, wa), (hb, wb) = bag(rl[i], tl[i]), bag(rr[j], tr[j])
            _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
            both = int(np.minimum(wa[ia], wb[ib]).sum())
            if 100 * both >= THRESHOLD_PERCENT * (int(wa.sum() + wb.sum()) - both):
                linked.add(cr[j])
                out.append((rl[i], rr[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, class_id`` of every document with words and a ``doc_id``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = written(spark, docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
                     .mapInArrow(_sketch, SKETCH), "sketch")
    reps = written(spark, sketch.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "representatives")
    keyed = reps.select("rep", F.explode("bands").alias("h"))
    sizes = (keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader"))
             .filter(F.col("n") > 1))
    members = written(spark, salted_join(keyed, sizes, ["h"], "inner", hot_keys(sizes, ["h"], "n")),
                      "buckets")
    star = members.filter(F.col("rep") != F.col("leader")).select(
        F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = verify(spark, docs, written(spark, star, "star-pairs"))
    comp = written(spark, components(spark, links), "components")

    more = remaining_links(spark, docs, members, reps, comp)
    if not more.isEmpty():
        comp = written(spark, components(spark, links.unionByName(more)), "components")
    rep_class = (reps.select("k1", "k2", "rep")
                 .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                 .select("k1", "k2", F.coalesce("component", "rep").alias("class_id")))
    keys = sketch.select("doc_id", "k1", "k2").distinct()
    heavy = hot_keys(keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_w")), ["k1", "k2"], "_w")
    return (salted_join(keys, rep_class, ["k1", "k2"], "inner", heavy, row_id=["doc_id"])
            .groupBy("doc_id").agg(F.min("class_id").alias("class_id")))


def candidates(spark: SparkSession, members: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
    """The members that a bucket's stars left uncompared and that are near one of another component
    of it by signature, by block and part, written.  No text is read."""
    m = (members.filter(F.col("n") > 2)
         .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
         .select("h", "rep", F.coalesce("component", "rep").alias("comp")))
    per = m.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("_c"))
    mixed = (per.groupBy("h").agg(F.sum("_c").alias("n"), F.max(F.struct("_c", "comp")).alias("_top"))
             .filter(F.col("n") > F.col("_top._c"))
             .select("h", F.col("_top.comp").alias("major"),
                     F.ceil((F.col("n") - F.col("_top._c")) / BLOCK_MEMBERS).cast("int").alias("_minor"),
                     F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int").alias("_all"), "n"))
    rows = written(spark, salted_join(m, mixed, ["h"], "inner", hot_keys(mixed, ["h"], "n")), "mixed")
    # one row per member and bucket gets its signature; the blocks then repeat these narrow rows
    rows = (rows.join(reps.select("rep", "sig", "bands"), "rep")
            .withColumn("_h", F.xxhash64("rep")).withColumn("minor", F.col("comp") != F.col("major")))
    facts = ["rep", "comp", "minor", "sig", "bands"]
    left = (rows.filter("minor")
            .select("h", F.pmod("_h", "_minor").cast("int").alias("i"),
                    F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("j"),
                    F.lit(0).alias("side"), *facts))
    right = rows.select("h", F.explode(F.sequence(F.lit(0), F.col("_minor") - 1)).alias("i"),
                        F.pmod("_h", "_all").cast("int").alias("j"), F.lit(1).alias("side"), *facts)
    return written(spark, left.unionByName(right).groupBy("h", "i", "j")
                   .applyInPandas(_candidates, CANDIDATE), "candidates")


def remaining_links(spark: SparkSession, docs: DataFrame, members: DataFrame, reps: DataFrame,
                    comp: DataFrame) -> DataFrame:
    """Links between different components of a bucket that the stars left uncompared (step 4)."""
    rows = candidates(spark, members, reps, comp)
    if rows.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    texts = _texts_of(spark, docs, rows.select(F.col("rep").alias("doc_id")).distinct())
    found = (rows.join(reps.select("rep", "sig", "bands"), "rep")
             .join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
             .groupBy("h", "i", "j", "part").applyInPandas(_compare, "a long, b long").distinct())
    return written(spark, found, "more-links")


def repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, differ`` of each ``doc_id`` with several rows, and whether their texts differ."""
    h = F.xxhash64("text", F.col("text").isNull())
    return written(spark, docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
                   .agg(F.count(F.lit(1)).alias("_n"), (F.min(h) != F.max(h)).alias("differ"))
                   .filter(F.col("_n") > 1).select("doc_id", "differ"), "repeated")


def number_texts(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with, for ``doc_id``, a number of each (doc_id, text), rising with doc_id, and the
    name of a further column that holds the ``doc_id``; rows without one keep a null."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name = "_" + name
        return name

    own, digest, number = free("_doc_id"), free("_text"), free("_number")
    known = docs.filter(F.col("doc_id").isNotNull()).withColumn(own, F.col("doc_id")).withColumn(
        digest, F.coalesce(F.sha2("text", 256), F.lit("")))
    numbers = written(spark, known.select(F.col("doc_id").cast("long").alias("doc_id"), own, digest).distinct()
                      .orderBy("doc_id", digest).select(
                          own, digest, F.monotonically_increasing_id().alias(number)), "numbers")
    # rows without a doc_id have nothing to join and would meet in one task
    numbered = (known.join(numbers, [own, digest]).withColumn("doc_id", F.col(number))
                .select(*docs.columns, own)
                .unionByName(docs.filter(F.col("doc_id").isNull())
                             .withColumn(own, F.col("doc_id"))
                             .withColumn("doc_id", F.lit(None).cast("long")).select(*docs.columns, own)))
    return written(spark, numbered, "numbered"), own


def _marked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = classes(spark, docs)
    return (ids.filter(F.col("doc_id").isNotNull()).join(found, "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
            .unionByName(ids.filter(F.col("doc_id").isNull()).withColumn("class_id", F.col("doc_id")))
            .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("class_id"))))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs``; one document of each class is kept."""
    if repeated(spark, docs).filter("differ").isEmpty():
        return _marked(spark, docs)
    docs, own = number_texts(spark, docs.select("doc_id", "text"))
    names = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(own).cast("long").alias("_name")).distinct()
    marked = _marked(spark, docs)
    return (marked.filter(F.col("doc_id").isNotNull()).join(names, "doc_id")
            .join(names.select(F.col("doc_id").alias("class_id"), F.col("_name").alias("_class")),
                  "class_id")
            .select(F.col("_name").alias("doc_id"), F.col("_class").alias("class_id"), "kept")
            .unionByName(marked.filter(F.col("doc_id").isNull())))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; rows that repeat a ``doc_id`` and its text once."""
    again = repeated(spark, docs)
    if again.filter("differ").isEmpty():
        return _keep_one(spark, docs, again.select("doc_id"))
    numbered, own = number_texts(spark, docs)
    kept = _keep_one(spark, numbered, repeated(spark, numbered).select("doc_id"))
    return kept.withColumn("doc_id", F.col(own)).select(*docs.columns)


def _keep_one(spark: SparkSession, docs: DataFrame, twice: DataFrame) -> DataFrame:
    found = classes(spark, docs)
    gone = written(spark, found.filter(F.col("doc_id") != F.col("class_id")).select("doc_id"), "copies")
    kept = attach_small(docs, gone, ["doc_id"], "left_anti")
    if twice.isEmpty():
        return kept
    return attach_small(kept, twice, ["doc_id"], "left_anti").unionByName(
        attach_small(kept, twice, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(spark, docs)
