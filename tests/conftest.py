import pytest

from assetry.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "8")
    yield session
    session.stop()
