"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import pytest

from symlattice import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted(str([tidy(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name])
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got[1]


def test_entry_imports_and_lists_all():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
