import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build_session

    s = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column function on one row of literals."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        row = spark.range(1).select(*[F.lit(v).alias(f"v{i}") for i, v in enumerate(values)])
        return row.select(fn(*[F.col(f"v{i}") for i in range(len(values))]).alias("x")).first().x

    return run
