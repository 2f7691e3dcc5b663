import pytest

from matchlab.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
