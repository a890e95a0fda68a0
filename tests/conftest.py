import os

import pytest

from gaugelake.session import build_session

# Python workers import what tests hand to them.
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (os.path.dirname(__file__), os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
