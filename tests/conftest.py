from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        shuffle_partitions=4,
        driver_memory="8g",
        extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tablewright-tests-")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
