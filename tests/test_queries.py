"""Every registered query against its DuckDB twin on the smallest data set."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from scalefold.operators.grids import whole_scales  # noqa: E402
from scalefold.plans.catalogue import ORACLE, QUERIES  # noqa: E402
from scalefold.plans.oracle import whole_grid_sql  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_query_has_a_twin():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() == 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    state, _, _ = compare(spark, con, SF, name)
    assert state.startswith("ok"), state


def test_whole_grid_sql_has_no_longest_series(con):
    """Scales of the twins against the operator's, for lengths below, at and beyond 32,768 samples."""
    lengths = [49, 50, 57, 64, 1000, 32767, 32768, 32776, 40000, 100003, 800000, 2**21 + 5]
    con.execute("create or replace temp table lens as select unnest(?::bigint[]) as n", [lengths])
    con.execute("create or replace temp table long as select n::varchar as series_id from (select n, unnest(range(n)) from lens)")
    got: dict[int, list[int]] = {}
    for name, _, s in con.sql(f"select * from ({whole_grid_sql('long')}) order by all").fetchall():
        got.setdefault(int(name), []).append(s)
    assert got == {n: whole_scales(n) for n in lengths if n >= 50}
