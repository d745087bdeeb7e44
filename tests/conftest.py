import pytest

from corpusmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, app="tests", memory="4g", shuffle_partitions=4)
    yield session
    session.stop()
