"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class of labelled documents is a Gaussian over the transformed
statistics of ``docstats.features``.  Its covariance is shrunk towards the
pooled one and a share of the pooled variances is added to the diagonal, so a
statistic that hardly varies within a class cannot rule alone.  The Cholesky
factor of each covariance is computed once; a document's score is the
logistic of the difference of the two log densities plus the log odds of the
classes.

Fitting reads at most ``FIT_ROWS`` labelled documents, the ones with the
smallest hash of ``doc_id`` (a bounded, reproducible sample of the labels);
their sums and products are added up by Spark.  Scoring is one pass over all
documents, without a shuffle.

Defined results: a null text counts as an empty one and is scored; a null
``doc_id`` has no label and is not held out; conflicting labels of one
document are not used; with no labels of a class the score is the other
class's (0.5 without any labels); repeated rows are scored one by one; an
empty table gives no rows.  Only ``doc_id`` and ``text`` are read, so other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docstats import FEATURES, features
from .tables import fold, keep_rows, labelled, table
from .textvec import blocks, column

FIT_ROWS = 50_000
FOLDS = 5               # documents of fold 0 are held out
SHRINK, RIDGE = 0.3, 1e-2
THRESHOLD = 0.3


def batch_features(texts: pa.Array) -> np.ndarray:
    parts = [features(b) for b in blocks(texts)]
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Two Gaussians; ``classes`` holds (mean, Cholesky factor, log determinant / 2) of labels 0, 1."""
    classes: list = field(default_factory=list)
    log_odds: float = 0.0
    constant: float | None = None       # the score where a class has no labels

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, chol, half_logdet in self.classes:
            z = np.linalg.solve(chol, (x - mean).T)
            density.append(-0.5 * np.einsum("ij,ij->j", z, z) - half_logdet)
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -700, 700)))


def fit_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK,
             ridge: float = RIDGE) -> Discriminant:
    """The model from each label's row count, sums and sums of products."""
    have = [k for k in (0, 1) if k in sums and sums[k][0] > 0]
    if len(have) < 2:
        return Discriminant(constant=float(have[0]) if have else 0.5)
    means = {k: sums[k][1] / sums[k][0] for k in have}
    scatter = {k: sums[k][2] - sums[k][0] * np.outer(means[k], means[k]) for k in have}
    cov = {k: scatter[k] / max(sums[k][0] - 1, 1) for k in have}
    pooled = (cov[0] + cov[1]) / 2
    classes = []
    for k in have:
        c = (1 - shrink) * cov[k] + shrink * pooled
        c = c + np.diag(ridge * np.diag(pooled) + 1e-4)
        chol = np.linalg.cholesky(c)
        classes.append((means[k], chol, float(np.log(np.diag(chol)).sum())))
    return Discriminant(classes, float(np.log(sums[1][0] / sums[0][0])))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Learn from the labelled documents outside fold 0."""
    d = len(FEATURES)
    sample = (labelled(labels, "quality").filter((fold(FOLDS) != 0) & F.col("label").isin(0, 1))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch_features(column(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    # at most fit_rows rows, so the broadcast has a proven bound
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("label", "text").mapInArrow(extract, "label int, x array<double>"))
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    got = (rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in pairs]).alias("ss")).collect())
    sums = {}
    for r in got:
        ss = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["ss"]):
            ss[i, j] = ss[j, i] = v
        sums[r["label"]] = (float(r["n"]), np.array(r["s"]), ss)
    return fit_sums(sums)


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` of every document."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch_features(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(s)], ["doc_id", "score"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(scored, "doc_id long, score double"))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored at ``threshold`` or more, with all their columns."""
    return keep_rows(docs, lambda b: model.score(batch_features(column(b, "text"))) >= threshold)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(FOLDS) == 0, F.lit(False))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))
