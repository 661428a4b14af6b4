import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from fieldtally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column_of(spark):
    """Evaluate ``expr(column)`` over many text values in one job, keeping their order."""

    def run(values, expr):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in df.select(expr(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]

    return run
