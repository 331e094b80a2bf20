"""One small session for all tests."""

import pytest

from stallkit.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="2", shuffle_partitions=3)
