import pytest

from veritab.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


@pytest.fixture
def rows(spark):
    """Build a small table from a DDL schema and tuples."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
