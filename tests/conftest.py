import pytest

from hearthlog.session import local_session

MIN = 60_000_000
HOUR = 60 * MIN
# Wednesday 2026-04-29 22:00 UTC.
BASE = 1_777_500_000_000_000


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "4g", partitions=4)


@pytest.fixture
def signals(spark):
    """Presence rows of one household from `(subject, minute, value)`, minutes after midnight."""
    def make(rows, start=0):
        data = [(0, s, "presence", start + int(m * MIN), i, v) for i, (s, m, v) in enumerate(rows)]
        return spark.createDataFrame(
            data, "household_id long, subject string, signal string, ts_us long, seq long, value string")
    return make


@pytest.fixture
def grid_of(spark):
    """Subjects with a grid of `n` slots from the epoch."""
    def make(n, *subjects):
        return spark.createDataFrame([(0, s, 0, n - 1) for s in subjects],
                                     "household_id long, subject string, start_slot long, stop_slot long")
    return make
