import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from holdspan.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples_of(spark):
    """Samples of one series from (start, end, value) triples."""

    def make(rows, site=0, series="a"):
        return spark.createDataFrame(
            [(site, series, s, e, float(v)) for s, e, v in rows],
            "site_id bigint, series_id string, start_ts bigint, end_ts bigint, value double",
        )

    return make


def rows(df, *columns):
    """Rows as sorted tuples of the named columns."""
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
