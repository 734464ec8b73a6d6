"""Every registered library query that has SQL gives the same rows as DuckDB."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pytest

from voxlake.plans import catalog, further  # noqa: F401  (add their queries)
from voxlake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot express, with the test that holds them against brute force.
BRUTE_FORCE = {"snippet_ranges": "test_library.py::test_snippets_equal_brute_force"}


def plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in BRUTE_FORCE:
        assert rows and name not in ORACLES
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == expected
