import pytest


@pytest.fixture(scope="session")
def docs_dir():
    return "/root/testdata/sf0.001"
