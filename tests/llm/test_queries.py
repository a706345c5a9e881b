"""The queries of the subpackage over the smallest tables."""

import duckdb
import pytest

from calibmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).collect()
    assert got
    if name in queries.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "token_budgets"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        assert sorted(map(tuple, got)) == sorted(c.sql(queries.ORACLES[name]).fetchall())
