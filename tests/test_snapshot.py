"""Graph queries on a stored snapshot, the identifier index, and the counts over a union."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from regmesh.operators import overlap, resolve, triples
from regmesh.operators.overlap import Source, distinct, either, joined
from regmesh.plans.queries import REGISTRY
from tests.conftest import SMOKE_DIR
from tests.util import rows

QUADS = "g string, s string, p string, o string, o_type string"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["resolve_identifier", "annotate_counts"])
def test_lookups_read_the_stored_index_and_no_quads(spark, name):
    plan = _plan(REGISTRY[name](spark, SMOKE_DIR))
    assert "regmesh_ids_" in plan and "regmesh_quads_" not in plan and "regmesh_graph_" not in plan


def test_cleared_graph_has_no_folder_to_read(spark):
    df = REGISTRY["clear_graph"](spark, SMOKE_DIR)
    assert df.inputFiles() and not any("patents" in f for f in df.inputFiles())


def test_graph_queries_do_not_copy_the_graph(spark):
    """Only the first query of an application loads it."""
    from regmesh.plans.queries import Ctx
    c = Ctx(spark, SMOKE_DIR)
    root, folders = c.graph().root, c.graph().folders()
    for name in ("annotated_graph", "delete_triple", "delete_predicate", "clear_graph"):
        new = {f.split("/g=")[0] for f in REGISTRY[name](spark, SMOKE_DIR).inputFiles()}
        assert f"{root}/{folders[0].batch}".split(":")[-1] in {f.replace("file://", "") for f in new}
    assert c.graph().root == root and c.graph().folders() == folders


def _quads(spark):
    def node(i, projects, values, scheme="rcn"):
        return ([("g", x, "has", i, "uri") for x in projects]
                + [("g", i, "name", scheme, "string")]
                + [("g", i, "value", v, "string") for v in values])
    typed = [("g", x, "type", "P", "uri") for x in ("p1", "p2", "p3")]
    return spark.createDataFrame(
        typed + node("i1", ["p3", "p2", "p0"], ["7", "8", "8"]) + node("i2", ["p1"], ["8", "9"])
        + node("i3", ["p1"], ["5"], "doi") + node("i4", ["p0"], ["6"]), QUADS)


def _index(quads, **more):
    return triples.identifier_index(quads, "g", type_pred="type", type_obj="P", has_id="has",
                                    id_name="name", id_value="value", scheme="rcn", **more)


def test_identifier_index_takes_the_smallest_project_of_each_value(spark):
    assert rows(_index(_quads(spark))) == [("7", "p2"), ("8", "p1"), ("9", "p1")]


def test_identifier_index_limited_to_the_values_of_a_lookup(spark):
    wanted = spark.createDataFrame([("8",), ("8",), ("none",), (None,)], "value string")
    assert rows(_index(_quads(spark), wanted=wanted)) == [("8", "p1")]


def test_counts_over_a_union_of_sides(spark):
    b = spark.createDataFrame([("x",), ("y",), (None,), ("x",)], "t string")
    c = spark.createDataFrame([("y",), ("z",), (None,)], "t string")
    keys = (("t", F.col("t")),)
    got = dict(rows(overlap.overlap_metrics(
        [Source(b, 1, keys), Source(c, 2, keys)],
        [either("any", "t", 1, 2), distinct("b", "t", 1), joined("both", "t", 1, 2)])))
    assert got == {"any": 4, "b": 3, "both": 1}


def test_rewrite_takes_the_project_by_title_and_the_org_by_acronym(spark):
    cols = "acronym string, projectURI string, title string, orgURI string, orgName string, country string"
    subjects = spark.createDataFrame(
        [("X", "b/1", " T1 ", "b/o1", "n", "c"),      # acronym and title agree
         ("x", "b/2", "other", "b/o2", "n", "c"),     # acronym alone agrees
         ("q", "b/3", "T1", "b/o1", "n", "c"),        # org known by its other row
         (None, "b/4", "T1", "b/o3", "n", "c")], cols)
    base = spark.createDataFrame([("x", "a/1", "t1", "a/o1", "n", "c")], cols)
    done = resolve.rewrite_uris(subjects, base, lambda c: F.trim(F.lower(c)))
    assert rows(done, "projectURI", "orgURI", "modify") == [
        ("a/1", "a/o1", 1), ("b/2", "a/o1", 0), ("b/3", "a/o1", 0), ("b/4", "b/o3", 0)]
    counts = resolve.rewrite_counts(done, "a/", "b/").collect()[0]
    assert tuple(counts) == (1, 2, 2)
