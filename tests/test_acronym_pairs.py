"""a subject row is given with every base row of its acronym, not with the first one."""

import pytest
from pyspark.sql import functions as F

from regmesh.operators import resolve, skew
from regmesh.plans.queries import REGISTRY
from tests.conftest import SMOKE_DIR
from tests.test_plans import physical_plan
from tests.test_shuffles import _registries
from tests.util import rows


def brute(subjects, base):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    low = {(r["acronym"] and r["acronym"].lower(), *r[1:]) for r in subjects.collect()}
    known = {}
    for r in base.select(F.lower("acronym"), "orgURI", "projectURI", "title").distinct().collect():
        if r[0] is not None:
            known.setdefault(r[0], []).append(tuple(r[1:]))
    return sorted([(*r, len(known.get(r[0], [])), *b) for r in low for b in known.get(r[0], [(None,) * 3])], key=key)


@pytest.mark.parametrize("target", [1_000_000, 50, 4])
def test_every_match_of_a_subject_row_is_given(spark, monkeypatch, target):
    """With and without hot acronyms cut into chunks, some of them empty."""
    monkeypatch.setattr(skew, "TARGET_ROWS", target)
    subjects, base = _registries(spark)
    hot = spark.range(30).select(F.lit("Acr1").alias("acronym"), F.concat(F.lit("h/p"), "id").alias("projectURI"),
                                 F.lit("t").alias("title"), F.lit(None).cast("string").alias("orgURI"))
    base = base.unionByName(hot).unionByName(hot.withColumn("acronym", F.lit(None).cast("string")))
    done = resolve.acronym_match(subjects, base, every=True)
    want = brute(subjects, base)
    assert rows(done) == want and max(r[6] for r in want) > 30
    assert done.columns == [*subjects.columns, "n_matches", "baseOrgURI", "baseProjectURI", "baseTitle"]


def test_the_query_has_a_row_for_every_pair(spark, duck):
    done = REGISTRY["acronym_match"](spark, SMOKE_DIR)
    assert done.filter("n_matches > 1").count() > 0
    per_subject = done.groupBy("acronym", "projectURI", "title", "orgURI", "orgName", "country", "n_matches")
    wrong = per_subject.count().filter("count <> greatest(n_matches, 1)")
    assert wrong.count() == 0


def test_pairs_of_a_hot_acronym_are_spread_over_tasks(spark, monkeypatch):
    """400 x 300 pairs of one acronym and 3,000 NULLs: no task has a third of the rows."""
    monkeypatch.setattr(skew, "TARGET_ROWS", 2_500)
    cols = ["projectURI", "title", "orgURI", "orgName", "country"]
    subjects = spark.range(3_400).select(F.when(F.col("id") < 400, "hot").alias("acronym"),
                                         *[F.col("id").cast("string").alias(c) for c in cols])
    base = spark.range(300).select(F.lit("HOT").alias("acronym"),
                                   *[F.col("id").cast("string").alias(c) for c in cols[:3]])
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")           # the list of hot acronyms
    try:
        done = resolve.acronym_match(subjects, base, every=True)
        per_task = [r[1] for r in done.groupBy(F.spark_partition_id()).count().collect()]
        assert "Window" not in physical_plan(done)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    assert sum(per_task) == 400 * 300 + 3_000
    assert len(per_task) == 8 and max(per_task) < sum(per_task) / 3
