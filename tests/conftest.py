import os
from pathlib import Path

import pytest

from noticeworks.session import local_session

DATA = Path(os.environ.get("NOTICEWORKS_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)
