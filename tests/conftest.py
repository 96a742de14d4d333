import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from regmesh.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="regmesh-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from regmesh.sources.tables import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE_DIR}/{t}.parquet')")
    yield con
    con.close()
