"""What joins and snapshots move: rows shuffled once, by the join's keys and salt, and sorted in bounded tasks."""

import re

import pytest
from pyspark.sql import functions as F

from regmesh.operators import resolve, skew, triples
from tests.test_plans import physical_plan
from tests.util import local_dir, rows


def _partitionings(df):
    """The columns that each shuffle of the plan is partitioned by."""
    found = re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", physical_plan(df))
    return [tuple(sorted(re.sub(r"#\d+L?", "", x).split(", "))) for x in found]


def _written_plans(monkeypatch, module):
    """Partitionings of every frame that ``module`` writes, by name."""
    real, seen = module.written, {}

    def spy(df, name):
        seen[name] = _partitionings(df)
        return real(df, name)
    monkeypatch.setattr(module, "written", spy)
    return seen


def _registries(spark):
    n = spark.range(3000).withColumn("k", F.col("id") % 300)
    subjects = n.select(
        F.when(F.col("k") % 5 > 0, F.concat(F.lit("ACR"), F.col("k") % 40)).alias("acronym"),
        F.concat(F.lit("b/p"), "k").alias("projectURI"),
        F.when(F.col("k") % 7 > 0, F.concat(F.lit(" T"), F.col("k") % 9)).alias("title"),
        F.concat(F.lit("b/o"), F.col("k") % 11).alias("orgURI"), F.lit("n").alias("orgName"), F.lit("c").alias("country"))
    base = spark.range(200).select(
        F.concat(F.lit("acr"), F.col("id") % 60).alias("acronym"), F.concat(F.lit("a/p"), "id").alias("projectURI"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 9)).alias("title"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("a/o"), "id")).alias("orgURI"))
    return subjects, base


def test_marking_hot_keys_shuffles_no_rows(spark):
    path = local_dir(spark, "marked")
    spark.range(1000).select((F.col("id") % 50).alias("k"), "id").write.parquet(path)
    big = spark.read.parquet(path)
    small = big.select("k").distinct().withColumn("w", F.lit(1))
    hot = skew.hot_keys(big.groupBy("k").agg(F.count(F.lit(1)).alias("_r")), ["k"], "_r", 10)
    for null_safe in (False, True):
        by = _partitionings(skew.salted_join(big, small, ["k"], "left", hot, null_safe))
        assert sum("_salt" not in p for p in by) <= 1        # the distinct of ``small``, no marking


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_rows_become_distinct_in_the_joins_own_shuffle(spark, how, monkeypatch):
    """no shuffle of the subjects by the acronym alone, nor by all their columns."""
    monkeypatch.setattr(skew, "TARGET_ROWS", 50)
    subjects, base = _registries(spark)
    done = resolve.acronym_match(subjects, base) if how == "left" else resolve.acronym_new(subjects, base)
    by = _partitionings(done)
    assert not [p for p in by if "country" in p]
    assert sum(p == ("acronym",) for p in by) <= 1           # the base side's aggregation
    known = {r["acronym"] for r in base.collect()}
    want = {(r["acronym"] and r["acronym"].lower(), *r[1:]) for r in subjects.collect()}
    if how == "left_anti":
        want = {r for r in want if r[0] not in known}
    assert rows(done, *subjects.columns) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_rewritten_rows_are_shuffled_once(spark, monkeypatch):
    """the subjects go through one shuffle, and are not written before."""
    monkeypatch.setattr(skew, "TARGET_ROWS", 50)
    subjects, base = _registries(spark)
    seen = _written_plans(monkeypatch, resolve)
    done = resolve.rewrite_uris(subjects, base, lambda c: F.trim(F.lower(c)))
    got = rows(done, *subjects.columns, "modify")
    assert "acronym-subjects" not in seen
    by = seen["rewritten-projects"]
    assert not [p for p in by if "country" in p] and sum("_salt" in p and "_tk" in p for p in by) >= 1
    assert sum("_tk" in p and "_salt" not in p for p in by) == 0

    org, project = {}, {}
    for r in base.collect():
        best = org.setdefault(r["acronym"], [])
        best.append((r["orgURI"] is None, r["orgURI"] or "", r["projectURI"]))
        if r["title"] is not None:
            project.setdefault((r["acronym"], r["title"]), []).append(r["projectURI"])
    subj = {(r["acronym"] and r["acronym"].lower(), *r[1:]) for r in subjects.collect()}
    orgs = {}
    for a, _, _, o, _, _ in subj:
        if a in org and not min(org[a])[0]:
            orgs.setdefault(o, []).append(min(org[a])[1])
    want = []
    for a, p, t, o, n, c in subj:
        found = project.get((a, t and t.strip().lower()))
        want.append((a, min(found) if found else p, t, min(orgs[o]) if o in orgs else o, n, c, 1 if found else 0))
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_tasks_of_a_snapshot_follow_the_number_of_quads(spark, monkeypatch):
    """no task sorts many more quads than ``TASK_QUADS``, however small they are."""
    monkeypatch.setattr(triples, "TASK_QUADS", 1000, raising=False)
    quads = spark.range(20_000).select(F.lit("g").alias("g"), F.concat(F.lit("s"), "id").alias("s"), F.lit("p").alias("p"),
                                       F.lit("o").alias("o"), F.lit("uri").alias("o_type"))
    path = local_dir(spark, "snapshot")
    triples.write_snapshot(quads, path)
    per_file = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 20_000 and max(per_file) <= 2000


def test_publications_make_titles_distinct_once(spark):
    """no distinct (uri, title) before the one of (canonical URI, title)."""
    orgs = spark.createDataFrame(
        [("N1", "n1", "u1", "t1"), ("n1", "n1", "u2", "t1"), ("n1", "n1", "u2", "t2"), ("n2", "n2", "u3", "t1"),
         ("n2", "n2", "u3", "t1"), ("n3", None, "u4", None), ("n3", "n3", None, "t9")],
        "orgName string, cleanName string, orgURI string, title string")
    done = resolve.merged_publications(orgs)
    by = _partitionings(done)
    assert ("orgURI", "title") not in by and by.count(("canonicalURI", "title")) == 1
    assert {r[0]: r[1] for r in done.collect()} == {"N1": 2, "n2": 1, "n3": 1}
