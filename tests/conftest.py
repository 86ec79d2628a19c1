import pytest

from seqlens.session import local_session, release


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(rows, schema): a small DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
