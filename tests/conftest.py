import pytest

from ledgerloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "6g"})
    yield s
    s.stop()
