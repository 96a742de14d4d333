"""Every registered query against its DuckDB oracle on sf0.001 (the driver's gate)."""

import pytest

import __spark_entry__ as se
from regmesh.plans.queries import REGISTRY
from tests.conftest import SMOKE_DIR
from tests.util import canon

SPARK_TO_DUCK = {
    "StringType": "VARCHAR", "LongType": "BIGINT", "IntegerType": "INTEGER",
    "DoubleType": "DOUBLE", "DecimalType": "DECIMAL(38,0)", "DateType": "DATE", "BooleanType": "BOOLEAN",
}

QUERIES = REGISTRY
SQL = {k: v for k, v in se.oracle_sql().items() if k in REGISTRY}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE_DIR)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    spark_types = {f.name: SPARK_TO_DUCK[type(f.dataType).__name__] for f in df.schema.fields}
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
    assert len(srows) == len(orows)
    assert canon(df.columns, srows) == canon(rel.columns, orows)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["pic", "organizationName", "totalBudget", "numberProjects"]
    assert df.count() > 0


@pytest.fixture()
def other_partitioning(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_does_not_depend_on_partitioning(other_partitioning, duck, name):
    """Same results with AQE off and three shuffle partitions."""
    spark = other_partitioning
    df = QUERIES[name](spark, SMOKE_DIR)
    rel = duck.sql(SQL[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(rel.columns, rel.fetchall())
