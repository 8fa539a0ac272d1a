import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from aidlens.session import local_session, shared_folder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "aidlens-tests")
    shared_folder(session)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Literal rows to a DataFrame, through one partition per row."""

    def make(data, schema):
        df = spark.createDataFrame(data, schema)
        return df.repartition(max(1, min(4, len(data)))) if data else df

    return make
