import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quireforge.session import local_session

    return local_session(4, 4, "4g")


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return con


def canonical(df):
    """Rows as sorted texts, whatever the types of whole numbers and missing values."""
    import pandas as pd

    def one(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list | tuple):
            return str([one(y) for y in x])
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "none"
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 6))
        return str(x)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(x) for x in r) for r in df.astype(object).itertuples(index=False, name=None))
