"""The registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

from modewave.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(pdf):
    out = []
    for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False):
        out.append(tuple("null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_the_cube_reads_the_columns_it_needs(spark):
    """The cube's plan reads the columns it needs and no more."""
    from modewave.plans import cube

    plan = cube.cube(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line]
    assert scans and not any("l_comment" in s or "l_returnflag" in s for s in scans)
