from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from boxlens.session import get_session

    s = get_session("local[*]", shuffle_partitions=8, app_name="boxlens-tests")
    yield s


@pytest.fixture(scope="session")
def tpch_tables(spark):
    from boxlens.sources.tables import Tables

    return Tables.from_tpch(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
