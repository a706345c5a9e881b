"""Queries p1 to p6 over empty tables, rows of nulls, and doubled rows with clashing extra columns."""

import pytest

from calibmill.functions.lexicon import NAMES, OTHER_NAMES, OTHER_TOP_KEYS, TOP_KEYS
from calibmill.operators.drift import ENTRY_ROLES
from calibmill.plans import training
from tests.odd_tables import write


def fixed_aliases():
    return [*NAMES, *OTHER_NAMES, *TOP_KEYS, *OTHER_TOP_KEYS, *ENTRY_ROLES]


@pytest.fixture(scope="module", params=["empty", "nulls", "doubled"])
def odd(request, spark, sf, tmp_path_factory):
    return request.param, write(spark, sf, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(training.QUERIES))
def test_query(spark, sf, odd, name):
    how, folder = odd
    got = training.QUERIES[name](spark, folder).collect()
    if how == "empty":
        assert not got or name in ("p6_dependencies", "p3_aliases")
    elif how == "nulls":
        expected = {"p6_found": 12, "p6_filled": 3, "p2_t1_seconds": 3, "p2_t1_units": 3, "p6_dependencies": 19, "p3_aliases": len(list(fixed_aliases()))}
        assert len(got) == expected.get(name, 0)
    elif name in ("p1_found", "p2_found", "p6_found"):
        assert len(got) == 2 * training.QUERIES[name](spark, sf).count()
    elif name in ("p3_found", "p4_found"):
        assert len(got) == training.QUERIES[name](spark, sf).count()
