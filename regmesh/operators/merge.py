"""Merging registries.

Money is summed as ``decimal(18,2)`` and returned as double, so the total
does not depend on the order rows arrive in (double sums do).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money_sum(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def union_all(*frames: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """U1 by name (the reference unions by position; names are safer)."""
    if cols:
        frames = tuple(f.select(*cols) for f in frames)
    return reduce(DataFrame.unionByName, frames)


def min_per_key(df: DataFrame, keys: list[str], values: list[str],
                outs: list[str] | None = None, empty: str | None = "",
                buckets: int | None = None) -> DataFrame:
    """Smallest value of string columns per key (A12 representative, quirk a4).

    Spark cannot hash-aggregate ``min`` over strings (the buffer is not
    fixed-width), so the aggregate is sort-based.  To keep that sort small and
    a hot key spread out:

    1. (key, value) rows are de-duplicated with a hash aggregate (map-side
       combine, shuffled on key and value);
    2. the distinct pairs are hash-repartitioned on (key, bucket of the
       value) and reduced to one minimum per bucket - a key with many
       distinct values is spread over ``buckets`` tasks.  The repartition is
       also what stops Catalyst from folding the distinct into the ``min``
       (``min`` ignores duplicates, so it otherwise would, and the sort would
       see raw rows);
    3. the per-bucket minima (at most ``buckets`` per key) are reduced per key.

    ``buckets`` is the number of shuffle partitions unless given, so a hot
    key's values spread over the whole cluster at any size.
    ``empty`` replaces an all-NULL group (``concat_ws`` of an empty set gives ``''``).
    """
    outs = outs or values
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = (df.select(*keys, *values).distinct()
         .withColumn("_b", F.pmod(F.xxhash64(*values), F.lit(buckets)))
         .repartition(*keys, "_b"))
    part = d.groupBy(*keys, "_b").agg(*[F.min(v).alias(v) for v in values])

    def agg(v, o):
        m = F.min(v)
        return (F.coalesce(m, F.lit(empty)) if empty is not None else m).alias(o)
    return part.groupBy(*keys).agg(*[agg(v, o) for v, o in zip(values, outs)])


def representative(frames: list[DataFrame], key: str, attr: str, out: str | None = None) -> DataFrame:
    """One value of ``attr`` per ``key`` over several sources.

    The reference keeps element 0 of a split ``collect_set`` - arbitrary and
    cut at separators (quirks a1-a5).  ``min`` is deterministic; an all-NULL
    group gives ``''`` like ``concat_ws`` of an empty set.
    """
    u = union_all(*frames, cols=[key, attr])
    return min_per_key(u, [key], [attr], [out or attr])


def org_budget(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q1: budget and project count per organisation id (pic).

    Reference steps: names = one name per pic over both sources; facts =
    distinct (pic, proj, budget) rows, then count(proj) and sum(budget) per
    pic; inner join on pic (so a NULL pic is dropped); sort.

    Plan: facts are two hash aggregations with map-side combine (a hot pic
    is split over its (proj, budget) values first, then one partial row per
    map task); names are the distinct (pic, name) pairs' minimum; the join
    is between two per-pic aggregates, hash-partitioned on pic already.
    """
    cols = ["pic", "orgName", "proj", "budget"]
    u = union_all(a, b, cols=cols).filter(F.col("pic").isNotNull())
    facts = (u.select("pic", "proj", "budget").distinct()
             .groupBy("pic").agg(money_sum("budget").alias("totalBudget"),
                                 F.count("proj").alias("numberProjects")))
    names = min_per_key(u, ["pic"], ["orgName"], ["organizationName"])
    return (facts.join(names, "pic")
            .select("pic", "organizationName", "totalBudget", "numberProjects")
            .orderBy(F.desc("totalBudget"), F.desc("numberProjects"), F.asc("pic")))


def region_budget(a: DataFrame, b: DataFrame, region: str = "country") -> DataFrame:
    """Q3: budget and project count per (region, source); duplicates kept."""
    cols = [region, "source", "proj", "budget"]
    u = union_all(a, b, cols=cols).withColumnRenamed(region, "region")
    return (u.groupBy("region", "source")
            .agg(money_sum("budget").alias("totalBudget"), F.count("proj").alias("numberProjects"))
            .orderBy(F.desc("totalBudget"), F.desc("numberProjects"), F.asc("region"), F.asc("source")))


def merged_titles(a: DataFrame, b: DataFrame, id_col: str = "vatID",
                  title: str = "title") -> DataFrame:
    """E9 merge step: distinct ``(id, lower(title))`` over both sources."""
    qa = a.select(F.col(id_col), F.lower(title).alias("ProjectTitle"))
    qb = b.select(F.col(id_col), F.lower(title).alias("ProjectTitle"))
    return qa.unionByName(qb).distinct()


def merge_by_id(a: DataFrame, b: DataFrame, id_col: str = "vatID",
                title: str = "title") -> DataFrame:
    """What source ``b`` adds to ``a`` per organisation id.

    merged       = distinct (id, lower(title)) over both sources
    countByBase  = rows of ``a`` per id (not distinct - as the reference, so
                   duplicate rows in ``a`` understate the gain)
    countByMerge = merged rows per id
    newProjects  = countByMerge - countByBase, kept when > 0

    The reference counts twice and joins the counts on the id.  Here every
    row is tagged with whether it came from ``a``; one aggregation per
    (id, title) keeps both the distinct merged row and the number of ``a``
    rows behind it, a second per id sums them.  The inner join of the
    reference becomes ``countByBase > 0`` (ids ``a`` does not have) and a
    non-NULL id.  Both aggregations combine map-side, so a hot id is one row
    per map task, never a fan-out.
    """
    ta = a.select(F.col(id_col), F.lower(title).alias("ProjectTitle"), F.lit(1).alias("_a"))
    tb = b.select(F.col(id_col), F.lower(title).alias("ProjectTitle"), F.lit(0).alias("_a"))
    per_title = (ta.unionByName(tb).filter(F.col(id_col).isNotNull())
                 .groupBy(id_col, "ProjectTitle").agg(F.sum("_a").alias("_na")))
    per_id = per_title.groupBy(id_col).agg(
        F.sum("_na").cast("bigint").alias("countByBase"),
        F.count(F.lit(1)).alias("countByMerge"))
    return (per_id.filter(F.col("countByBase") > 0)
            .withColumn("newProjects", F.col("countByMerge") - F.col("countByBase"))
            .filter(F.col("newProjects") > 0))


def total(df: DataFrame, col: str, out: str) -> DataFrame:
    """A5: global sum as a one-row frame (NULL when empty, like SQL)."""
    return df.agg(F.sum(col).cast("bigint").alias(out))
