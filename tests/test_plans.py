"""Plan lint: scale properties every registered query must keep.

Checked on the physical plan (before execution) of each query at sf0.001:
no cartesian or nested-loop join, no window operator (a hot key would land in
one task), no Python evaluation (UDF or pandas) and no explicit broadcast hint.
"""

import pytest

from regmesh.plans.queries import REGISTRY
from tests.conftest import SMOKE_DIR

QUERIES = REGISTRY
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def physical_plan(df) -> str:
    """The physical plan as ``explain`` prints it (public API, captured)."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_unscalable_operator(spark, name):
    plan = physical_plan(QUERIES[name](spark, SMOKE_DIR))
    found = [op for op in FORBIDDEN if op in plan]
    assert not found, f"{name}: {found}"


def test_library_has_no_unbounded_broadcast_or_collect():
    import pathlib
    src = pathlib.Path(__file__).resolve().parents[1] / "regmesh"
    files = {p.name: p.read_text() for p in src.rglob("*.py")
             if "llm" not in p.relative_to(src).parts}
    text = "\n".join(files.values())
    for bad in (".hint(", ".collect()", ".toPandas(", "localCheckpoint", "crossJoin(", "udf("):
        assert bad not in text, bad
    # no broadcast by hint, no random salt, no fixed number of salts or rows
    for bad in ("F.broadcast(", "F.rand(", ".limit(top_k)", "coalesce(1)", "mkdtemp"):
        assert bad not in text, bad


@pytest.mark.parametrize("name", ["rewrite_uris", "rewrite_counts", "northern_projects", "multi_row_names",
                                  "canonical_uri", "acronym_org_map", "alias_members", "resolve_identifier"])
def test_base_tables_are_planned_at_most_twice(spark, name):
    """Later steps read what the first one wrote, not the registries again."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical_plan(QUERIES[name](spark, SMOKE_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for table in ("orders", "customer", "nation", "lineitem", "supplier", "events", "part", "documents"):
        assert plan.count(f"/{table}.parquet]") <= 2, table
