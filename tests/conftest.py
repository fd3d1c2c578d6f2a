import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture(scope="session")
def spark():
    from tidewright.session import get_session

    s = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture
def rows():
    """All rows of a frame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=str)
