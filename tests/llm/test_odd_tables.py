"""Queries p7 to p9 over empty tables, rows of nulls, and doubled rows with clashing extra columns."""

import pytest

from calibmill.llm import queries
from tests.odd_tables import write


@pytest.fixture(scope="module", params=["empty", "nulls", "doubled"])
def odd(request, spark, sf, tmp_path_factory):
    return request.param, write(spark, sf, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, odd, name):
    how, folder = odd
    got = queries.QUERIES[name](spark, folder).collect()
    if how == "empty":
        assert not got
    elif how == "nulls":
        assert len(got) == (3 if name == "p8_clean" else 0)
    elif name in ("p9_pieces", "p9_found"):  # budgets are doubled too
        assert len(got) == 4 * len(queries.QUERIES[name](spark, sf).collect())
