"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from specframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(rows):
    def one(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    found = got.select(*[f"`{n}`" for n in names]).collect()
    assert norm(found) == norm(cur.fetchall())
    assert found, "an empty result proves nothing"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["spec_id", "scan_time", "target", "mz", "i"] and e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark):
    """Filters and columns reach the scan; short target lists go without a shuffle of peaks for the match."""
    plan = catalog.QUERIES["point_lookup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,6)]" in plan and "o_custkey" not in plan
    plan = catalog.QUERIES["has_peak"](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = catalog.QUERIES["t_mz_semi"](spark, SF)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "NestedLoop" not in plan


def test_traces_of_all_peaks(spark):
    """Nothing of a spectrum is left out of its plot."""
    peaks = catalog._peaks(spark, SF).count()
    assert catalog.QUERIES["stick_trace_all"](spark, SF).count() == 4 * peaks > 4 * catalog._top(spark, SF).count()
