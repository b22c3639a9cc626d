import pytest

from tidemark.session import local_session, share_package


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", memory="4g", shuffles=4)
    s.sparkContext.setLogLevel("ERROR")
    share_package(s)
    return s
