import pytest


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The operators run many small jobs here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
