"""Embedding near-dedup with spherical-cap filters (random product codes).

A filter is a direction; a vector belongs to it if their inner product
reaches a height, that is, if the vector lies in a spherical cap.  Vectors
within the threshold of each other share most of their caps, other vectors
few.  Directions are the words of ``TURNS`` product codes: after a random
rotation the coordinates are cut into two halves, each with its own ``M``
random unit directions, and every pair of them is one of ``M * M`` filters.  List
decoding finds all filters of a vector without trying them all: with the
inner products of the second half in order, the partners of a direction of
the first half are a prefix.

``plan_filters`` derives height and ``M`` from the number of vectors: a
bucket holds about ``BUCKET`` unrelated vectors whatever the input, and two
vectors at the threshold are expected to share ``SHARED`` filters (the
integral over the sphere); closer pairs share more.  Recall is checked
against brute force in the tests.

Equal vectors are one representative with a count.  Representatives meet by
filter; large buckets are cut into blocks whose pairs are dealt over the
cluster.  Rows travel with 16-bit vectors; a block decides the pairs that the
rounding cannot move across the threshold, and vectors with a pair too close
to call meet again with their exact components, in double precision.  A pair
counts only in the smallest filter its two vectors share, so each link is
counted once; a block emits one count per vector and a spanning forest, never
the pairs.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, and rows with a null ``vec_id``, link with nothing and
are kept; vectors of different lengths never link; rows that repeat a
``vec_id`` count as vectors of their own; an empty table gives no rows.  Only
``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from .components import components
from .tables import table, written

THRESHOLD = 0.95
BUCKET, SHARED = 64, 10
TURNS = 6               # independent product codes
BLOCK = 512
SEED = 7
DEAL = 16               # buckets of one block size that one call compares
FULL = 32767            # of a rounded vector's largest component
COUNT, LINK, OPEN = 0, 1, 2
FOUND = ("a", "b", "kind", "n", "g", "i", "j", "f")


@dataclass(frozen=True)
class Code:
    """``TURNS`` product codes, each behind its own rotation, for vectors of ``dim`` components."""
    dim: int
    size: int           # directions per half
    height: float
    seed: int = SEED

    def parts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rng = np.random.default_rng([self.seed, self.dim])
        cut = (self.dim + 1) // 2
        codes = []
        for _ in range(TURNS):
            turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
            halves = []
            for width in (cut, max(self.dim - cut, 1)):
                c = rng.standard_normal((self.size, width))
                halves.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(2))
            codes.append((turn, *halves))
        return codes

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filters of each row of ``unit`` (its best ones where it reaches none)."""
        found: list[list[np.ndarray]] = [[] for _ in unit]
        for k, (turn, c1, c2) in enumerate(self.parts()):
            x = unit @ turn
            cut = c1.shape[1]
            s1 = x[:, :cut] @ c1.T
            s2 = x[:, cut:] @ c2.T if x.shape[1] > cut else np.zeros((len(x), self.size))
            for row, a, b in zip(found, s1, s2):
                order = np.argsort(-b)
                down = -b[order]
                i = np.flatnonzero(a - down[0] >= self.height)
                if not len(i):
                    row.append(np.array([(k * self.size + a.argmax()) * self.size + order[0]]))
                    continue
                n = np.searchsorted(down, a[i] - self.height, "right")
                j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                row.append(np.sort(np.repeat(k * self.size + i, n) * self.size + j))
        return [np.concatenate(row).astype(np.int32) for row in found]


def plan_filters(n: int, dim: int, threshold: float = THRESHOLD, bucket: int = BUCKET,
                 shared: float = SHARED) -> Code:
    """Height and code size for ``n`` vectors of ``dim`` components."""
    p = min(0.02, bucket / max(n, 1))
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** max((dim - 3) / 2, 0)
    density /= density.sum()
    above = np.cumsum(density[::-1])[::-1]                  # P(<x, c> >= t)
    height = float(t[min(np.searchsorted(-above, -p), len(t) - 1)])
    # given <x, c> = t, <y, c> = threshold * t + sqrt(1 - threshold^2) sqrt(1 - t^2) s
    inner = np.maximum(1 - t * t, 0) ** max((dim - 4) / 2, 0)
    tail = np.cumsum((inner / inner.sum())[::-1])[::-1]
    cap = t >= height
    need = (height - threshold * t[cap]) / (math.sqrt(1 - threshold ** 2)
                                            * np.sqrt(np.maximum(1 - t[cap] ** 2, 1e-12)))
    both = float((density[cap] * np.interp(need, t, tail, left=1.0, right=0.0)).sum())
    return Code(dim, max(2, math.ceil(math.sqrt(shared / TURNS / max(both, 1e-12)))), height)


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    scale = np.abs(x).max(1, keepdims=True)                 # no overflow in the squares
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rounded(unit: np.ndarray) -> np.ndarray:
    """Unit vectors as 16-bit integers, the largest component at full scale."""
    return np.rint(unit / np.abs(unit).max(1, keepdims=True) * FULL).astype("<i2")


def _block_links(keys: np.ndarray, filters: list, here: int, half: np.ndarray, weight: np.ndarray,
                 threshold: float, short: np.ndarray, unit: np.ndarray | None = None) -> pd.DataFrame:
    """Counts and a spanning forest of the links of one block.

    ``half``: 0 or 1 for the block's two chunks; -1 where it is one chunk against itself.
    ``short``: the rounded vectors.  Without ``unit`` a pair links where its rounded cosine is above
    the threshold by more than the rounding can move it, and the vectors of pairs too close to call
    are returned as ``open``; with the exact ``unit`` vectors just those pairs are decided."""
    smaller = [f[f < here] for f in filters]
    names, at = np.unique(np.concatenate(smaller), return_inverse=True)
    share = np.zeros((len(keys), max(len(names), 1)), np.float32)
    share[np.repeat(np.arange(len(keys)), [len(f) for f in smaller]), at] = 1
    near = short.astype(np.float64)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    moved = math.sqrt(near.shape[1]) * np.abs(near).max(1) / FULL * 1.01
    cosine = near @ near.T
    slack = moved[:, None] + moved[None, :] + moved[:, None] * moved[None, :] + 1e-12
    maybe = np.abs(cosine - threshold) <= slack
    mine = share @ share.T < 0.5                            # no smaller filter in common
    np.fill_diagonal(mine, False)
    if (half >= 0).any():
        mine &= half[:, None] != half[None, :]
    open_ = np.zeros(0, np.int64)
    if unit is None:
        hit = (cosine >= threshold) & ~maybe & mine
        open_ = np.flatnonzero((maybe & mine).any(1))
    else:
        hit = maybe & mine & (unit @ unit.T >= threshold)
    if not hit.any() and not len(open_):
        return pd.DataFrame({"a": [], "b": [], "kind": [], "n": []})
    label = np.arange(len(keys))
    while True:
        least = np.minimum(label, np.where(hit, label[None, :], len(keys)).min(1))
        if (least == label).all():
            break
        label = least
    n = hit @ weight
    linked = np.flatnonzero(n > 0)
    tree = linked[label[linked] != linked]
    return pd.DataFrame({"a": np.concatenate([keys[linked], keys[tree], keys[open_]]),
                         "b": np.concatenate([np.full(len(linked), -1), keys[label[tree]],
                                              np.full(len(open_), -1)]),
                         "kind": np.repeat([COUNT, LINK, OPEN], [len(linked), len(tree), len(open_)]),
                         "n": np.concatenate([n[linked], np.zeros(len(tree) + len(open_))])})


def link_rows(spark: SparkSession, reps: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Counts ``(a, n)`` and forest links ``(a, b)``, told apart by ``kind``, of representatives
    ``(rep, weight, v)`` of one length.

    The rows that meet by filter are wide and many, so they move once: a vector as 16-bit integers
    with its filters below the row's, in one binary.  Only filters above one block are listed by
    size (a short table, joined by its size).  Pairs whose rounded cosine is too close to call
    are decided in a second round from the exact vectors, which only their vectors take part in."""
    code = plan_filters(reps.count(), dim, threshold)
    vector = reps.schema["v"].dataType.simpleString()

    def decode(frames):
        for pdf in frames:
            if len(pdf):
                pdf["filters"] = code.decode(_unit(list(pdf["v"])))
                yield pdf

    def spread(frames):
        for pdf in frames:
            if len(pdf):
                short = _rounded(_unit(list(pdf["v"])))
                lens = pdf["filters"].map(len).to_numpy()
                yield pd.DataFrame({
                    "f": np.concatenate(list(pdf["filters"])), "rep": np.repeat(pdf["rep"].to_numpy(), lens),
                    "weight": np.repeat(pdf["weight"].to_numpy(), lens),
                    "packed": [head + f[:k].astype("<i4").tobytes()
                               for head, f in zip((x.tobytes() for x in short), pdf["filters"])
                               for k in range(len(f))]})

    coded = written(spark, reps.mapInPandas(
        decode, f"rep long, weight long, v {vector}, filters array<int>"), "filters")
    large = written(spark, coded.select(F.explode("filters").alias("f")).groupBy("f")
                    .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BLOCK)
                    .select("f", F.ceil(F.col("_n") / BLOCK).cast("int").alias("chunks")), "large-filters")
    rows = (coded.mapInPandas(spread, "f int, rep long, weight long, packed binary")
            .join(large, "f", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))))
    chunk = F.pmod(F.xxhash64("rep"), "chunks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = (rows.withColumn("c", chunk).withColumn("o", other)
            .withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
            # buckets of one block are dealt to calls several at a time
            .withColumn("g", F.when(F.col("chunks") == 1, F.floor(F.col("f") / DEAL))
                        .otherwise(-1 - F.col("f"))))

    def blocks(pdf: pd.DataFrame, links) -> pd.DataFrame:
        parts = []
        for f, one in pdf.groupby("f", sort=True):
            i, j = int(one["i"].iloc[0]), int(one["j"].iloc[0])
            half = np.full(len(one), -1) if i == j else (one["c"] == j).to_numpy().astype(int)
            got = links(f, one, half)
            if len(got):
                parts.append(got.assign(g=one["g"].iloc[0], i=i, j=j, f=f))
        if not parts:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in FOUND}).astype({"n": "int64"})
        return pd.concat(parts)[list(FOUND)].astype("int64")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def links(f, one, half):
            short = np.frombuffer(b"".join(p[:2 * dim] for p in one["packed"]), "<i2").reshape(-1, dim)
            below = [np.frombuffer(p, "<i4", offset=2 * dim) for p in one["packed"]]
            got = _block_links(one["rep"].to_numpy(), below, f, half, one["weight"].to_numpy(np.float64),
                               threshold, short)
            return got
        return blocks(pdf, links)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        def links(f, one, half):
            unit = _unit(list(one["v"]))
            return _block_links(one["rep"].to_numpy(), list(one["filters"]), f, half,
                                one["weight"].to_numpy(np.float64), threshold, _rounded(unit), unit)
        return blocks(pdf, links)

    schema = ", ".join(f"{c} long" for c in FOUND)
    first = written(spark, rows.select("g", "i", "j", "f", "c", "rep", "weight", "packed")
                    .groupBy("g", "i", "j").applyInPandas(compare, schema), "clear-links")
    chunks = F.coalesce("chunks", F.lit(1))
    open_ = (first.filter(F.col("kind") == OPEN)
             .select("g", F.col("i").cast("int"), F.col("j").cast("int"), F.col("f").cast("int"), F.col("a").alias("rep"))
             .join(large, "f", "left").withColumn("c", F.pmod(F.xxhash64("rep"), chunks).cast("int")))
    second = (open_.join(coded, "rep").select("g", "i", "j", "f", "c", "rep", "weight", "v", "filters")
              .groupBy("g", "i", "j").applyInPandas(decide, schema))
    return first.filter(F.col("kind") != OPEN).unionByName(second).select("a", "b", "kind", "n")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    wide = vectors.select("embedding").schema[0].dataType.simpleString() == "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>" if wide else "array<float>").alias("v"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & v.isNotNull() & finite & some, F.lit(False))
    # two 64-bit hashes name equal vectors
    rows = written(spark, rows.withColumn("ok", usable)
                   .withColumn("k1", F.when(F.col("ok"), F.xxhash64("v")))
                   .withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(SEED), F.reverse("v")))), "vectors")
    reps = written(spark, rows.filter("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")), "reps")
    dims = [r["d"] for r in reps.groupBy(F.size("v").alias("d")).count().select("d").collect()]
    found = None
    for d in dims:                                          # one length in any sane table
        one = link_rows(spark, reps.filter(F.size("v") == d).select("rep", "weight", "v"), d, threshold)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(spark, found, "links")
    linked = found.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(spark, found.filter(F.col("kind") == LINK).select("a", "b")).withColumnRenamed("node", "rep")
    # a representative stands for its copies, the smallest vec_id of which is itself
    facts = (reps.select("k1", "k2", "rep", "weight").join(linked, "rep", "left").join(comp, "rep", "left")
             .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id"), "weight"))
    heavy = hot_keys(facts, ["k1", "k2"], "weight")
    return (salted_join(rows.select("vec_id", "k1", "k2"), facts.drop("weight"), ["k1", "k2"], "left",
                        heavy, row_id=["vec_id"])
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id"))))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))
