"""Every core query over the smallest tables, against its SQL in DuckDB where it has some."""

import glob
import math
import os

import duckdb
import pytest

from calibmill.plans import calibration, training

ORACLES = calibration.ORACLES | training.ORACLES
QUERIES = calibration.QUERIES | training.QUERIES


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9) + 0.0
        return v if v is None or isinstance(v, (int, bool)) else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    elif name not in ("p3_found",):
        assert got
