import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from terselake.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ship(local_session(os.environ.get("TEST_CPUS", "4"), partitions=4, memory="4g", app="tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
