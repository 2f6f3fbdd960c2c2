import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def pytest_configure(config):
    # Test modules build Columns at import time; they need a live session.
    from invoxa.session import get_spark
    get_spark("local[4]", shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    from invoxa.session import get_spark
    yield get_spark("local[4]", shuffle_partitions=4)


def one(spark, expr_col, value, schema="x string"):
    """Evaluate a Column expression on a one-row frame with column x."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_col.alias("r")).first()["r"]
