"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by its own
permutation (offset + j * skip, both from a hash of its name) and the shards
take turns, each claiming the next free slot of its order, until the table
is full.  All shards so own nearly the same number of slots, and adding or
removing one moves little more than its own share.  A document's slot is a
hash of its key modulo the size; the table, whose size is a parameter, is
broadcast, so placement is one lookup without a shuffle.

``write_shards`` writes one folder per shard; a shard's rows are dealt over
as many tasks as its size asks for, so a hot shard is not one task.  The query
places and writes whole documents and returns what it reads back from the
shard folders.

Defined results: a null key goes to the slot of the key's hash like any
other value, repeated rows to the same shard, an empty table gives no rows.
Columns ``slot`` and ``shard`` of the input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_dir, table

SLOTS = 65_537          # a prime
SHARDS = 64
DOCS_PER_FILE = 10_000      # whole texts: some 35 MB of them in the given tables


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The index of the shard that owns each slot."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots:
        raise ValueError("slots must be a prime, at least the number of shards")
    start, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % slots)
        skip.append(int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1)
    owner = np.full(slots, -1, np.int32)
    at, left = list(start), slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            left -= 1
            if not left:
                return owner


def slot_of(*key: Column | str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def place(spark: SparkSession, df: DataFrame, key: Sequence[str], shards: Sequence[str],
          slots: int = SLOTS) -> DataFrame:
    """``df`` with its ``slot`` and ``shard`` (name); the row count is unchanged."""
    owner = lookup_table(shards, slots)
    names = spark.createDataFrame(pa.table({
        "slot": pa.array(np.arange(slots, dtype=np.int32)),
        "shard": pa.array(np.array(shards, object)[owner], pa.string())}))
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*kept, slot_of(*key, slots=slots).alias("slot"))
    # the lookup table has `slots` rows whatever the data
    return placed.join(F.broadcast(names), "slot", "left").select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder ``shard=...`` per shard, with files of about ``rows_per_file`` rows at most."""
    parts = max(1, -(-placed.count() // rows_per_file))
    (placed.repartitionByRange(parts, "shard", F.xxhash64(*placed.columns))
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = place(spark, table(spark, sf_dir, "documents"), ["doc_id"], shard_names())
    path = shared_dir(spark, "shards")
    write_shards(placed, path, DOCS_PER_FILE)
    return spark.read.schema(placed.schema).parquet(path).select("doc_id", "slot", "shard")
