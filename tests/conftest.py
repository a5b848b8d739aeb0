import pytest

from tests.oracle import session
from veriweave import configure


@pytest.fixture(scope="session")
def spark():
    s = configure(session())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
