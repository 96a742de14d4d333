"""Corpus pipeline: four stages over ``documents``, each written as Parquet and read by the next.

1. quality classifier: documents that it rejects go;
2. quality rules: documents that they reject go;
3. MinHash near-dedup: one document of each group stays;
4. best-fit packing: one row per piece of a document, with its sequence.

The first three return the columns of ``documents``.  No stage can be
expressed as SQL over the given tables (a fitted discriminant, a likelihood
ratio, Poisson signatures, a tokenizer), so there is no oracle; the tests
hold the result against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regmesh.llm import minhash_dedup, packing, quality_classifier, quality_rules
from regmesh.llm.tables import table, written

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("quality_rules", quality_rules.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("best_fit_packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, from the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
