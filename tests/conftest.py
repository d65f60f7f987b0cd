import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tessera-tests", master="local[8]", partitions=8, spark__driver__memory="8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)
