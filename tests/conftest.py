import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quarrystone.session import session

    s = session("local[4]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "4g", "spark__default__parallelism": "4",
        "spark__sql__adaptive__coalescePartitions__parallelismFirst": "false", "spark__driver__host": "127.0.0.1",
    })
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over views made from pandas frames or Parquet."""
    import duckdb

    def run(sql, **frames):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for name, frame in frames.items():
            con.register(name, frame)
        return con.execute(sql).df()

    return run


@pytest.fixture(scope="session")
def same():
    """Compares two pandas frames as sets of rows, columns by name."""
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from compare import normal

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert normal(a) == normal(b)

    return check
