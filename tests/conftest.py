import os

import pytest

from parley.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "parley-tests")
    yield session
    session.stop()
