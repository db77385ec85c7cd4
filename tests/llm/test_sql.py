"""Queries of the subpackage against their SQL, on small tables of the driver."""

import math
import os

import duckdb
import pytest

from specframe.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet/*.parquet')" if os.path.isdir(f"{SF}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.SQL[name])
    names = [c[0] for c in cur.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    a, b = sorted(cur.fetchall()), sorted(tuple(r) for r in got.select(*names).collect())
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert all(math.isclose(p, q, abs_tol=2e-6) if isinstance(p, float) else p == q for p, q in zip(x, y)), (x, y)
