"""Hot keys: one clean name holds a third of all rows.

The registry views are rewritten so every third row of registries A and B
carries the same organisation name; AQE skew thresholds are lowered so the
skew-join path is exercised at this size.  Results must still equal brute
force computed with DuckDB on the same rows.
"""

import pytest
from pyspark.sql import functions as F

from regmesh.operators import overlap, resolve, skew
from regmesh.sources import fixtures as fx
from regmesh.sources.tables import Tables
from tests.conftest import SMOKE_DIR

HOT = "the hot organisation"
SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.autoBroadcastJoinThreshold": "-1",          # force shuffle joins
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    target, skew.TARGET_ROWS = skew.TARGET_ROWS, 200
    t = Tables(spark, SMOKE_DIR)
    orgs = fx.all_orgs(t)
    hot = F.abs(F.xxhash64("orgURI", "title")) % 3 == 0
    orgs = orgs.withColumn("cleanName", F.when(hot & (F.col("source") != "C"), F.lit(HOT))
                           .otherwise(F.col("cleanName")))
    yield orgs
    skew.TARGET_ROWS = target
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _pdf(df):
    return [tuple(r) for r in df.collect()]


def test_hot_name_really_holds_a_third(skewed):
    n = skewed.count()
    hot = skewed.filter(F.col("cleanName") == HOT).count()
    assert hot > n / 4


def test_canonical_uri_under_skew(spark, skewed, duck):
    rows = _pdf(skewed.select("cleanName", "orgURI"))
    duck.execute("CREATE OR REPLACE TEMP TABLE sk(cleanName VARCHAR, orgURI VARCHAR)")
    duck.executemany("INSERT INTO sk VALUES (?, ?)", rows)
    want = dict(duck.sql("""
        WITH m AS (SELECT DISTINCT cleanName, orgURI FROM sk WHERE orgURI IS NOT NULL),
        g AS (SELECT cleanName, min(orgURI) AS gmin FROM m WHERE cleanName IS NOT NULL GROUP BY 1)
        SELECT m.orgURI, COALESCE(min(g.gmin), m.orgURI) FROM m LEFT JOIN g USING (cleanName)
        GROUP BY m.orgURI""").fetchall())
    got = {r[0]: r[1] for r in resolve.canonical_uri(skewed).collect()}
    assert got == want


def test_multi_row_flag_and_groups_under_skew(spark, skewed):
    flagged = resolve.flag_multi_row_names(skewed)
    assert flagged.count() == skewed.count()
    hot_flags = {r[0] for r in flagged.filter(F.col("cleanName") == HOT)
                 .select("multi_row_name").distinct().collect()}
    assert hot_flags == {True}
    groups = {r["cleanName"]: r["n_uris"] for r in resolve.alias_groups(skewed).collect()}
    want = skewed.filter(F.col("cleanName") == HOT).select("orgURI").distinct().count()
    assert groups[HOT] == want


def test_title_delta_under_skew(spark, skewed):
    a = skewed.filter(F.col("source") == "A")
    b = skewed.filter(F.col("source") == "B")
    got = {r["metric"]: r["value"]
           for r in overlap.shared_title_delta([a, b], [("p", 0, 1)]).collect()}
    na = {r[0] for r in a.select("cleanName").distinct().collect()}
    nb = {r[0] for r in b.select("cleanName").distinct().collect()}
    shared = na & nb
    ta = {r[0] for r in a.filter(F.col("cleanName").isin(*[s for s in shared if s]))
          .select("title").distinct().collect()}
    tb = {r[0] for r in b.filter(F.col("cleanName").isin(*[s for s in shared if s]))
          .select("title").distinct().collect()}
    assert got["p_shared_names"] == len(shared)
    assert (got["p_titles_a"], got["p_titles_b"]) == (len(ta), len(tb))


def test_salting_spreads_the_hot_name_over_tasks(spark, skewed):
    """Rows per join task: without salting one task would get the hot third."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        flagged = resolve.flag_multi_row_names(skewed)
        per_task = [r[1] for r in flagged.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    total = sum(per_task)
    hot = skewed.filter(F.col("cleanName") == HOT).count()
    assert hot / total > 0.2
    # unsalted, the task holding the hot name would carry at least its share
    assert max(per_task) / total < 0.75 * hot / total


def test_null_and_hot_keys_spread_over_tasks(spark, skewed):
    """30 % NULL keys and one key with a third of the rows: no task over three times the median."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 40_000
        r = F.col("id") % 100
        big = spark.range(n).select(
            F.when(r < 30, F.lit(None)).when(r < 64, F.lit("hot"))
            .otherwise(F.concat(F.lit("k"), F.col("id") % 3001)).alias("k"), "id")
        small = big.filter(F.col("k").isNotNull()).select("k").distinct().withColumn("w", F.lit(1))
        hot = skew.hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("_r")), ["k"], "_r", 200)
        for how in ("left", "left_anti"):
            side = small if how == "left" else small.filter(F.col("k") != "hot")
            j = skew.salted_join(big, side, ["k"], how, hot)
            per_task = sorted(x[1] for x in j.groupBy(F.spark_partition_id()).count().collect())
            assert per_task[-1] <= 3 * per_task[len(per_task) // 2]
            assert sum(per_task) == (n if how == "left" else n * 64 // 100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_salt_does_not_depend_on_row_order(spark):
    big = spark.range(1000).select((F.col("id") % 3).cast("string").alias("k"), "id")
    small = spark.createDataFrame([("0", "a"), ("1", "b")], "k string, w string")
    hot = spark.createDataFrame([("0", 8)], "k string, _n int")

    def plan_salts(df):
        h = df.select("id", F.pmod(F.xxhash64(*df.columns), F.lit(8)).alias("salt"))
        return {x["id"]: x["salt"] for x in h.collect()}

    assert plan_salts(big) == plan_salts(big.orderBy(F.desc("id")))
    a = skew.salted_join(big, small, ["k"], "left", hot)
    b = skew.salted_join(big.orderBy(F.desc("id")).repartition(5), small, ["k"], "left", hot)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
