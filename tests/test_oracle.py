"""Each engine query against its SQL in DuckDB, over whole tables."""

import duckdb
import pytest

from terravane import queries

SF = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(map(str, (tuple(r[c] for c in order) for r in got.collect())))
    at = [want.columns.index(c) for c in order]
    assert rows == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_every_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()
