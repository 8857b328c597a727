import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema): a DataFrame in a few partitions, from rows of the test."""
    return lambda rows, schema, parts=3: spark.createDataFrame(rows, schema).repartition(parts)
