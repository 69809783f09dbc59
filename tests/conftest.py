from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quire.session import build_session

    session = build_session("quire-tests", "local[8]", 8, input_tasks=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column over one row of named string values."""
    from pyspark.sql import functions as F

    def run(column_of, *texts, schema=None):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([texts], schema or ", ".join(f"{n} string" for n in names))
        return df.select(column_of(*[F.col(n) for n in df.columns]).alias("v")).first()["v"]

    return run
