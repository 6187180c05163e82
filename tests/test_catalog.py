"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from orebed.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{f}')")
    return con


def rows(cells):
    return sorted(str(tuple(round(c, 9) if isinstance(c, float) else c for c in r)) for r in cells)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF_DIR)
    names = sorted(got.columns)
    told = duck.execute(catalog.ORACLE_SQL[name])
    assert sorted(c[0] for c in told.description) == names
    columns = ", ".join(f'"{c}"' for c in names)
    want = duck.execute(f"SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert rows(map(tuple, got.select(*names).collect())) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark):
    def plan(name):
        return catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()

    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan("content_sha256")
    assert "html" not in plan("path_verdict").split("ReadSchema")[-1]
    assert "CartesianProduct" not in plan("keyword_theta") and "NestedLoop" not in plan("keyword_theta")
