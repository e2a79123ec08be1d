import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from folioloom.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    def cell(x):
        if isinstance(x, (bool, np.bool_, str, list, np.ndarray)):
            return str(x)
        return "null" if pd.isna(x) else f"{float(x):.9g}"

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        assert rows(got) == rows(oracle.execute(SQL[name]).df())
    else:
        assert len(got) > 0
