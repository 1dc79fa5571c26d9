"""Every tree query against its SQL, which reads the tables and no trees."""

import time

import duckdb
import pytest

from canopy.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages", "conversations")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    # the SQL leans on no optimizer
    c.execute("SET threads = 1; SET memory_limit = '1GB'; PRAGMA disable_optimizer")
    return c


@pytest.mark.parametrize("name", [*sorted(registry.QUERIES)[::4], *registry.OTHERS])
def test_rows_equal_those_of_the_sql(spark, tables, name):
    out = registry.queries()[name](spark, DATA)
    found = tables.execute(registry.oracle_sql()[name])
    columns, rows = [c[0] for c in found.description], found.fetchall()
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(rows)


def test_every_sql_is_cheap(tables):
    assert registry.oracle_sql().keys() == registry.queries().keys()
    for sql in registry.oracle_sql().values():
        began = time.perf_counter()
        tables.execute(sql).fetchall()
        assert time.perf_counter() - began < 3
