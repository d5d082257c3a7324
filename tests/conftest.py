import os

import pytest

from lantern.session import get_session


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("LANTERN_DRIVER_MEMORY", "3g")
    session = get_session("local[4]", 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
