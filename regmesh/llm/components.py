"""Connected components of a link table, by alternating star contraction.

Each round re-links every node to the smallest node it knows (large star:
larger neighbours to the smallest; small star: smaller neighbours to the
smallest), until only stars are left; the rounds grow with the logarithm of
the longest path.  Every round is an aggregation that combines before it
shuffles and a join whose hot nodes are split by weight, and is written to
the shared folder, so the lineage stays short and a lost executor costs its
own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from .tables import written


def _star(edges: DataFrame) -> DataFrame:
    """``u, v`` directed rows to ``v, min(u, neighbours of u)``."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"),
                                   F.count(F.lit(1)).alias("_w"))
    return salted_join(edges, least.drop("_w"), ["u"], "inner", hot_keys(least, ["u"], "_w"))


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node of ``links(a, b)``.

    Null ends and self links are dropped; links may repeat and may point
    either way; without links there are no rows.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = (links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    edges = written(spark, edges, "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_star(both).filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _star(large)                      # every row has v < u, so m is the least of v
        small = small.select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(spark, small.filter(F.col("u") != F.col("v")).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
