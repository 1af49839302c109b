"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lakemetrics.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted(str([value(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    mine = QUERIES[name](spark, DATA)
    duck.execute(ORACLE[name])
    names = [d[0] for d in duck.description]
    assert sorted(names) == sorted(mine.columns)
    assert rows(mine.columns, mine.collect()) == rows(names, duck.fetchall())


def test_every_query_runs_on_given_tables(spark):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE) <= set(e.oracle_sql())
