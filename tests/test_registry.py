"""Every core query runs on the smallest tables and equals its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

from tarnwork.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view \"{os.path.basename(f)[:-8]}\" as select * from '{f}'")
    return c


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 4) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, data, name):
    df = registry.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(canon, r)) for r in df.select(cols).collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert rows == sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())
