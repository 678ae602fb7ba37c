import pytest

from siftline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=2)
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Make (stream_id, seq, raw) from texts of one stream."""

    def make(*texts, stream="s"):
        return spark.createDataFrame(
            [(stream, i, t) for i, t in enumerate(texts, 1)], "stream_id string, seq bigint, raw string"
        )

    return make
