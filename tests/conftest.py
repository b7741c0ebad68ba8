import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import build_session

    session = build_session("local[8]", "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame, doubles rounded."""
    def read(df, digits=9):
        def plain(v):
            return round(v, digits) if isinstance(v, float) else v
        return sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    return read
