from __future__ import annotations

import pytest

from epochloom.session import local_session, prepare


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
