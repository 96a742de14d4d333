"""Hot-key splitting for joins against a per-key frame.

Most joins here put a large frame (rows, or distinct pairs) against a frame
with at most one row per key (an aggregate).  A single key may hold a third
of the large side.  AQE's skew-join split does not help in this shape: it
only handles joins whose two children are plain shuffle stages, while the
per-key side here is an aggregate whose own shuffle already provides the
join's distribution.  So hot keys are split explicitly:

1. ``hot_keys``: every key whose weight (rows of the large side) exceeds
   ``target_rows``, with its number of salts ``ceil(weight / target_rows)``.
   At most ``total / target_rows`` keys pass.  ``salted_join`` writes the list
   first: its size is then known when the join is planned, which broadcasts it
   without a hint.  Planned by estimate it was shuffled, and with it every row
   of both sides, all rows of a NULL or hot key into one partition.
2. ``salted_join``: a large-side row of a hot key gets a salt in ``[0, n)``,
   other rows salt 0; the per-key row of a hot key is replicated once per
   salt.  The join runs on (key, salt): a hot key is spread over ``n`` tasks
   of about ``target_rows`` rows whatever the volume, and every large-side
   row still meets exactly one copy of its per-key row, so results are those
   of the plain join for inner, left outer, left semi and left anti joins.

The salt is a hash of the row itself, never a random number: a map task that
is run again after an executor is lost must send each row to the partition
it was sent to before, in whatever order the rows come back.  Rows equal in
every column share a salt; pass ``row_id`` (more columns to hash) where the
large side holds many equal rows.

Rows with a NULL key match nothing (unless ``null_safe``), so in a left or
anti join their salt is free: they are spread by the same hash instead of
meeting in the one partition of NULL.

``distinct=True`` makes the large side's rows distinct in the join's own
shuffle: equal rows have the same keys and the same salt, so they meet there,
and the rows are not shuffled by all their columns before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

TARGET_ROWS = 1_000_000     # rows of one key that one join task should hold
NULL_SALTS = 1 << 20        # salts of NULL-key rows (they meet no copy, so this costs nothing)


def hot_keys(weights: DataFrame, keys: list[str], weight: Column | str,
             target_rows: int | None = None) -> DataFrame:
    """Keys heavier than ``target_rows`` and their number of salts ``_n``."""
    target = target_rows or TARGET_ROWS
    w = F.col(weight) if isinstance(weight, str) else weight
    return (weights.select(*keys, w.alias("_w")).filter(F.col("_w") > target)
            .select(*keys, F.ceil(F.col("_w") / F.lit(target)).cast("int").alias("_n")))


def _eq(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str,
                hot: DataFrame, null_safe: bool = False,
                row_id: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """``big JOIN small USING(keys)`` with the keys in ``hot`` spread over their ``_n`` salts.

    ``small`` must hold at most one row per key.  ``how``: inner, left,
    left_semi or left_anti.  The output has big's columns followed by small's
    non-key columns (as a ``USING`` join would), without helper columns.
    ``distinct``: of equal rows of ``big`` one stays.
    """
    hk = [f"_hk{i}" for i in range(len(keys))]
    # one row per hot key: a repeated one would multiply the marked rows
    h = written(hot.groupBy(*[F.col(k).alias(a) for k, a in zip(keys, hk)])
                .agg(F.max("_n").alias("_n")), "hot-keys")

    def mark(df: DataFrame) -> DataFrame:
        cond = reduce(lambda x, y: x & y,
                      [_eq(F.col(k), F.col(a), null_safe) for k, a in zip(keys, hk)])
        return df.join(h, cond, "left").drop(*hk)

    row_hash = F.xxhash64(*[F.col(c) for c in (row_id or big.columns)])
    salt = F.when(F.col("_n").isNotNull(), F.pmod(row_hash, F.col("_n")))
    if not null_safe and how in ("left", "left_anti"):
        any_null = reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
        salt = salt.when(any_null, F.pmod(row_hash, F.lit(NULL_SALTS)))
    b = (mark(big).withColumn("_salt", salt.otherwise(F.lit(0)).cast("int")).drop("_n"))
    if distinct:
        b = b.repartition(*keys, "_salt").distinct()
    s = (mark(small)
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
         .drop("_n"))
    sk = [f"_sk{i}" for i in range(len(keys))]
    s = s.select(*[F.col(k).alias(a) for k, a in zip(keys, sk)],
                 *[c for c in s.columns if c not in keys])
    cond = reduce(lambda x, y: x & y,
                  [_eq(b[k], s[a], null_safe) for k, a in zip(keys, sk)]) & (b["_salt"] == s["_salt"])
    j = b.join(s, cond, how)
    if how in ("left_semi", "left_anti"):
        return j.drop("_salt")
    return j.drop(*sk).drop(b["_salt"]).drop(s["_salt"])
