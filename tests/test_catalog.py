"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

from palimpsest import catalog
from tests.oracle import connect, duck_rows, spark_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = spark_rows(df)
    if name in SQL:
        columns, expected = duck_rows(duck, SQL[name])
        assert sorted(df.columns) == columns
        assert rows == expected


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
