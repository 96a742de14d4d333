"""Reading the tables, and helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shared_dir

SMALL_ROWS = 2_000_000      # a side of this many id rows (about 32 MB) may be broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs start from files
    that outlive any executor, and nothing above is computed again."""
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def kept(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], object]]:
    """As ``written``, and what deletes the files again, to be called once no later job reads them:
    a managed table in a database of its own, whose folder is in the shared one."""
    path, base = shared_dir(spark, name).replace("'", "\\'"), f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{path}'")
    df.write.format("parquet").saveAsTable(f"{base}.{name}")
    return spark.table(f"{base}.{name}"), lambda: spark.sql(f"DROP DATABASE {base} CASCADE")


def fold(of: int, key: str = "doc_id") -> Column:
    """crc32 of the key's text modulo ``of``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(of))


def attach_small(big: DataFrame, small: DataFrame, keys: list[str], how: str,
                 limit: int = SMALL_ROWS) -> DataFrame:
    """Join that broadcasts ``small``, a written table, when it has at most ``limit`` rows, and
    shuffles beyond; rows of ``big`` with a null key match nothing and are not shuffled then."""
    if small.count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    null = reduce(or_, [F.col(k).isNull() for k in keys])
    found = big.filter(~null).join(small, keys, how)
    if how not in ("left", "left_anti"):
        return found
    return found.unionByName(big.filter(null), allowMissingColumns=True)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label`` of the documents whose non-null labels all agree, once each."""
    return (labels.select("doc_id", F.col(column).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
            .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_max"))
            .filter(F.col("label") == F.col("_max")).drop("_max"))


def keep_rows(df: DataFrame, mask: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``df`` whose flag is set; ``mask`` gives the flags of a batch."""
    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(mask(batch)))
    return df.mapInArrow(filtered, df.schema)


__all__ = ["SMALL_ROWS", "attach_small", "ensure_checkpoint_dir", "fold", "keep_rows", "kept", "labelled",
           "shared_dir", "table", "written"]
