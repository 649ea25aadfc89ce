"""Every query with SQL gives the SQL's rows at the smallest scale."""

import os

import duckdb
import pytest

from pagewright import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    found = catalog.queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = database.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(plain(v) for v in r)) for r in want)


def test_entry_runs_without_the_training_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_reading_order_takes_columns_before_rows():
    from pagewright.operators.reading_order import ordered

    left = [(0, 100 - 14 * i, 90, 10) for i in range(5)]
    right = [(110, 100 - 14 * i, 90, 10) for i in range(5)]
    mixed = [b for pair in zip(left, right, strict=True) for b in pair]
    assert ordered(mixed, 11) == [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    heading = [(0, 140, 200, 12), *mixed]
    assert ordered(heading, 11)[0] == 0 and ordered(heading, 11)[1:6] == [1, 3, 5, 7, 9]
    assert ordered([], 11) == []
