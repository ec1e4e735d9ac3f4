"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tallymark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return str(v)[:19] if hasattr(v, "hour") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted([tuple(cell(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in cursor.fetchall()], key=str)
    assert sorted([tuple(cell(r[c]) for c in sorted(columns)) for r in df.collect()], key=str) == want


@pytest.mark.parametrize(("name", "n"), [("json_deep_diff", 60000), ("json_deep_diff_ordered", 12000)])
def test_long_documents_equal_sql(spark, tmp_path, name, n):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT range AS event_id, CASE WHEN range < {n} THEN 50 ELSE 1 END AS user_id, 'view' AS event_type FROM range({n + 100})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    got = [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
