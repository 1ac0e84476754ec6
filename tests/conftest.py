import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
