import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
for path in (HERE, os.path.dirname(HERE)):
    if path not in sys.path:
        sys.path.insert(0, path)

import pytest  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def queries():
    import __spark_entry__ as E
    return E.queries()


@pytest.fixture(scope="session")
def small():
    """Tables of the smallest driver data as lists of rows."""
    import duckdb

    def read(name, columns, sf=SF_SMALL):
        return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf}/{name}.parquet') ORDER BY 1").fetchall()

    return read
