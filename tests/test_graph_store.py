"""The stored graph: updates touch only what they change, the index is joined without a shuffle."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from regmesh.operators import graph_store, triples
from tests.util import rows

Q = "g string, s string, p string, o string, o_type string"
QUADS = [("G", "p/1", "type", "Project", "uri"), ("G", "p/2", "type", "Project", "uri"),
         ("G", "p/1", "field", "physics", "string"), ("G", "p/2", "field", "bio", "string"),
         ("H", "x", "type", "Patent", "uri"), ("K:/+%'\\é", "x", "a=b c", "o", "uri")]
PATTERN = dict(type_pred="type", type_obj="P", has_id="has", id_name="name", id_value="value", scheme="rcn")


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def files(root):
    """Every data file under a store with its size and time of change."""
    top = root.removeprefix("file:")
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_size, os.stat(os.path.join(d, f)).st_mtime_ns)
            for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


@pytest.fixture()
def store(spark):
    return graph_store.create(spark, spark.createDataFrame(QUADS, Q))


def test_a_stored_graph_gives_its_quads_and_graphs_back(spark, store):
    assert rows(store.quads()) == sorted(QUADS)
    assert [r["g"] for r in store.graphs().collect()] == sorted({q[0] for q in QUADS})
    assert [r["g"] for r in store.graphs(2).collect()] == sorted({q[0] for q in QUADS})[:2]


def test_insert_appends_one_batch_and_writes_no_old_file_again(spark, store):
    before = files(store.root)
    new = spark.createDataFrame([("G", "p/1", "field", "physics", "string"), ("G", "p/1", "field", "chem", "string"),
                                 ("G", "p/1", "field", "chem", "string"), ("N", "n", "field", "chem", "string")], Q)
    after, batch = store.insert(new)
    assert rows(after.batch(batch)) == [("G", "p/1", "field", "chem", "string"), ("N", "n", "field", "chem", "string")]
    assert rows(after.quads()) == sorted(QUADS + [("G", "p/1", "field", "chem", "string"),
                                                  ("N", "n", "field", "chem", "string")])
    assert rows(store.quads()) == sorted(QUADS)                  # the old snapshot stays as it was
    now = files(store.root)
    assert {f: now[f] for f in before} == before
    assert set(store.folders()) < set(after.folders())
    again, nothing = after.insert(new)
    assert again.batch(nothing).count() == 0 and rows(again.quads()) == rows(after.quads())


def test_delete_rewrites_only_the_batches_that_hold_a_doomed_quad(spark, store):
    grown, batch = store.insert(spark.createDataFrame([("G", "p/9", "field", "chem", "string")], Q))
    before = files(store.root)
    doomed = spark.createDataFrame([("G", "p/1", "field", "physics", "string"), ("G", "p/1", "field", "none", "string"),
                                    ("H", "x", "type", "Patent", "string"), ("Z", "z", "z", "z", "uri")], Q)
    left = grown.delete(doomed)
    assert rows(left.quads()) == sorted(set(QUADS) - {("G", "p/1", "field", "physics", "string")}
                                        | {("G", "p/9", "field", "chem", "string")})
    gone = set(grown.folders()) - set(left.folders())
    assert {(f.g, f.p) for f in gone} == {("G", "field")} and batch not in {f.batch for f in gone}
    now = files(store.root)
    assert {f: now[f] for f in before} == before
    assert left.delete(doomed).name == left.name                 # nothing to delete: the same snapshot


def test_predicates_and_graphs_go_without_reading_or_writing(spark, store):
    before = files(store.root)
    left = store.delete_predicate("G", "field")
    assert rows(left.quads()) == sorted(q for q in QUADS if (q[0], q[2]) != ("G", "field"))
    cleared = left.clear_graph("G")
    assert rows(cleared.quads()) == sorted(q for q in QUADS if q[0] != "G")
    assert rows(cleared.clear_graph("none").quads()) == rows(cleared.quads())
    assert files(store.root) == before
    assert "FileScan" not in plan(cleared.graphs()) and "Scan parquet" not in plan(cleared.graphs())


def test_rows_without_a_graph_or_predicate_are_refused(spark):
    bad = spark.createDataFrame([(None, "s", "p", "o", "uri"), ("g", "s", "", "o", "uri"),
                                 ("g", "s", "p", None, None)], Q)
    assert graph_store.quads_without_partition(bad).count() == 2
    with pytest.raises(Exception, match="a quad needs a value in"):
        graph_store.create(spark, bad)


def test_an_empty_store_takes_an_insert(spark):
    none = graph_store.create(spark, spark.createDataFrame([], Q))
    assert none.quads().count() == 0 and none.graphs().count() == 0 and not none.folders()
    grown, _ = none.insert(spark.createDataFrame(QUADS, Q))
    assert rows(grown.quads()) == sorted(QUADS)
    assert grown.clear_graph("G").delete(spark.createDataFrame(QUADS, Q)).quads().count() == 0


def id_quads(spark):
    def node(i, projects, values, scheme="rcn"):
        return ([("g", x, "has", i, "uri") for x in projects] + [("g", i, "name", scheme, "string")]
                + [("g", i, "value", v, "string") for v in values])
    typed = [("g", x, "type", "P", "uri") for x in ("p1", "p2", "p3")]
    return spark.createDataFrame(
        typed + node("i1", ["p3", "p2", "p0"], ["7", "8", "8"]) + node("i2", ["p1"], ["8", "9"])
        + node("i3", ["p1"], ["5"], "doi") + node("i4", ["p0"], ["6"]), Q)


def test_the_index_is_built_once_and_shared_by_snapshots_that_keep_its_folders(spark):
    store = graph_store.create(spark, id_quads(spark))
    index = store.identifier_index("g", **PATTERN)
    assert rows(index) == [("7", "p2"), ("8", "p1"), ("9", "p1")]
    before = len(spark.catalog.listTables())
    grown, _ = store.insert(spark.createDataFrame([("g", "p1", "field", "x", "string")], Q))
    tables = len(spark.catalog.listTables())
    grown.identifier_index("g", **PATTERN)
    assert len(spark.catalog.listTables()) == tables > before    # found again, not built again
    more, _ = grown.insert(spark.createDataFrame([("g", "p0", "type", "P", "uri")], Q))
    assert rows(more.identifier_index("g", **PATTERN)) == [("6", "p0"), ("7", "p0"), ("8", "p0"), ("9", "p1")]


def test_a_lookup_joins_the_index_without_shuffling_it(spark):
    store = graph_store.create(spark, id_quads(spark))
    index = store.identifier_index("g", **PATTERN)
    items = spark.createDataFrame([("a", 7), ("b", 8), ("c", 1), ("d", None), ("e", 8)], "id string, rcn int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = triples.resolve_identifier(items, index, "rcn")
        text = plan(found)
        got = rows(found, "id", "projectURI")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == [("a", "p2"), ("b", "p1"), ("c", ""), ("d", ""), ("e", "p1")]
    assert "Bucketed: true" in text or "SelectedBucketsCount" in text
    tree = text.split("== Physical Plan ==")[1].split("\n\n\n")[0].splitlines()
    scan = next(i for i, line in enumerate(tree) if "Scan parquet" in line and "regmesh_ids" in line)

    def depth(line):
        return len(line) - len(line.lstrip(" +-:"))
    at, above = depth(tree[scan]), []
    for line in reversed(tree[:scan]):                           # the scan's ancestors up to its join
        if depth(line) < at:
            at = depth(line)
            above.append(line)
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)


def test_hot_values_are_looked_up_once_each(spark):
    index = spark.createDataFrame([("1", "p")], "value string, projectURI string")
    items = spark.range(1000).select(F.lit(1).alias("rcn"), "id")
    assert triples.resolve_identifier(items, index, "rcn").filter("projectURI = 'p'").count() == 1000
