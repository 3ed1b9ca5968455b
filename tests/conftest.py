import pytest

from karyoflux.runtime import session


@pytest.fixture(scope="session")
def spark():
    return session(4, 4)
