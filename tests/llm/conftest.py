import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
