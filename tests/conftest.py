import os

import pytest

from tidemark.session import local_session, share_package

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="4", memory="4g", shuffles=4)
    s.sparkContext.setLogLevel("ERROR")
    share_package(s)
    return s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    return DATA
