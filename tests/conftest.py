import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from versarium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "versarium-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Apply a column function to a list of strings, keeping their order."""
    from pyspark.sql import functions as F

    def run(fn, items, kind="string"):
        df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]
    return run
