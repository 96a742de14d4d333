"""Graph joins go by the size of rows, not of files: nothing that grows with the graph is broadcast."""

import pytest
from pyspark.sql import functions as F

from regmesh.operators import graph_store, triples
from regmesh.session import shared_dir
from tests.test_plans import physical_plan
from tests.util import rows

N = 60_000
PATTERN = dict(type_pred="type", type_obj="P", has_id="has", id_name="name", id_value="value", scheme="rcn")
Q = "g string, s string, p string, o string, o_type string"


@pytest.fixture(scope="module")
def store(spark):
    """One identifier per project, every third named otherwise; sorted files, far smaller than the rows."""
    x, i = F.concat(F.lit("p/"), "id"), F.concat(F.lit("id/"), "id")

    def q(s, p, o, kind):
        return F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_type"))
    quads = (spark.range(1_000_000, 1_000_000 + N)
             .select(F.inline(F.array(q(x, "type", F.lit("P"), "uri"), q(x, "has", i, "uri"),
                                      q(i, "name", F.when(F.col("id") % 3 == 0, "doi").otherwise("rcn"), "string"),
                                      q(i, "value", F.col("id").cast("string"), "string"),
                                      q(x, "field", F.lit("physics"), "string"))))
             .select(F.lit("g").alias("g"), "s", "p", "o", "o_type"))
    return graph_store.create(spark, quads)


@pytest.fixture()
def threshold(spark):
    """More than the files of a side, less than its rows."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, str(8 * N))
    yield
    spark.conf.set(key, old)


def broadcasts(df):
    """Broadcast joins of the plan as it was run, but for those with the list of hot keys."""
    df.collect()
    return [line for line in physical_plan(df).splitlines() if "BroadcastHashJoin" in line and "_hk0" not in line]


def test_the_index_is_built_without_broadcasting_nodes(spark, store, threshold, monkeypatch):
    real, frames = triples.written, []

    def spy(df, *args, **kw):
        frames.append(df)
        return real(df, *args, **kw)
    monkeypatch.setattr(triples, "written", spy)
    index = triples.identifier_index(store.quads(), "g", **PATTERN)
    assert [line for df in [*frames, index] for line in broadcasts(df)] == []
    assert index.count() == sum(i % 3 > 0 for i in range(1_000_000, 1_000_000 + N))
    assert index.filter("projectURI <> concat('p/', value)").count() == 0


def test_a_lookup_of_many_values_broadcasts_neither_side(spark, store, threshold):
    index = store.identifier_index("g", **PATTERN)
    items = spark.range(1_000_000, 1_000_000 + 2 * N).withColumnRenamed("id", "rcn")
    done = triples.resolve_identifier(items, index, "rcn")
    assert broadcasts(done) == []
    assert done.filter("projectURI <> ''").count() == index.count()


def test_found_items_are_not_broadcast(spark, store, threshold):
    """With the rows that were not found filtered out, either side of the last join could be."""
    path = shared_dir(spark, "items")
    (spark.range(1_000_000, 1_000_000 + N).select(F.col("id").alias("rcn"), F.lit("a category").alias("category"))
     .coalesce(1).write.parquet(path))
    index = store.identifier_index("g", **PATTERN)
    done = triples.field_triples(triples.resolve_identifier(spark.read.parquet(path), index, "rcn"), "g", "field", "category")
    assert broadcasts(done) == []
    assert done.count() == index.count()


def test_an_insert_compares_without_a_join(spark, store, threshold):
    new = spark.createDataFrame([("g", "p/1000000", "field", "physics", "string"), ("g", "p/1", "field", "bio", "string"),
                                 ("g", "p/1", "field", "bio", "string")], Q)
    there = store.quads().filter("p = 'field'")
    assert "Join" not in physical_plan(triples.new_only(there, new))
    assert rows(triples.new_only(there, new)) == [("g", "p/1", "field", "bio", "string")]


def test_a_quad_with_a_null_is_inserted_once(spark):
    """As SQL's EXCEPT has it: a NULL is the same as another."""
    new = spark.createDataFrame([("G", "p/1", "field", None, "string")], Q)
    store = graph_store.create(spark, spark.createDataFrame([("G", "p/1", "field", "physics", "string")], Q))
    once, _ = store.insert(new)
    twice, batch = once.insert(new)
    assert once.quads().count() == 2
    assert twice.batch(batch).count() == 0
