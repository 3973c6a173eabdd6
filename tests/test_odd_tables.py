"""Every core query over tables without rows, and over rows of nulls."""

import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarnwork.plans import registry

#: Queries that write their table as a file to read back, whose formats have no empty form.
FILES = {"i_matrix"}
#: Queries that must raise on a class they do not know, null among them.
RAISES = {"v_grades"}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def odd(request, data, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for f in glob.glob(f"{data}/*.parquet"):
        schema = pq.read_schema(f)
        n = 0 if request.param == "empty" else 3
        pq.write_table(pa.table({c.name: pa.nulls(n, c.type) for c in schema}, schema=schema), f"{d}/{os.path.basename(f)}")
    return str(d)


@pytest.mark.parametrize("group", sorted({n.split("_")[0] for n in registry.queries()}))
def test_no_query_fails(spark, odd, group):
    failed = {}
    for name, query in registry.queries().items():
        if name.split("_")[0] == group and name not in FILES | (RAISES if "nulls" in odd else set()):
            try:
                query(spark, odd).collect()
            except Exception as e:  # all failures of the group are told at once
                failed[name] = str(e)[:200]
    assert not failed
