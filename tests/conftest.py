from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]



@pytest.fixture(scope="session")
def spark():
    from lumisonde.session import build_session, ship

    session = build_session("tests", cores=4, memory="4g")
    session.sparkContext.setLogLevel("OFF")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    return session
