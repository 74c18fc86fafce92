"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session, ship

    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    return session
