import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from strataq.session import build_session

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
