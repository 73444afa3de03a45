import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from wardflow.session import get_session

    session = get_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
