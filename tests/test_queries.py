import os

import duckdb
import pytest

from tablewright import catalog
from tablewright.plans.base import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((str([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.oracle_sql()[name])
    assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
