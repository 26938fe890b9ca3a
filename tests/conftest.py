from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemill.session import build_session, share_code


@pytest.fixture(scope="session")
def spark():
    session = build_session(cores=4, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    yield session
    session.stop()
