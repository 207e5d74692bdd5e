import pytest

from loomtext.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, name="tests")
    yield session
    session.stop()
