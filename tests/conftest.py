import pytest

from calibmill.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def sf():
    return SF
