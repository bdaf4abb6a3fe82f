import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from rosterlab.session import test_session

    session = test_session("8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
