import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from feedcore.session import local_session

    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Evaluate a column expression over a list of texts."""

    def evaluate(values, expression, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
        from pyspark.sql import functions as F

        rows = df.select("i", expression(F.col("t")).alias("r")).orderBy("i").collect()
        return [r.r for r in rows]

    return evaluate
