from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tilespark.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("BENCH_CPUS", "4"), 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
