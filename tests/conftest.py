"""One session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pairloom.session import local_session

    made = local_session(4, 4)
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
