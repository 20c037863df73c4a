import pytest

from lanternfish import session


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", cores=8, memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
