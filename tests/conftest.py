import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import local_session, release

    session = local_session("4", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("SHELFWISE_TEST_DATA", "/root/testdata/sf0.001")
