"""Every core query against its SQL, and the rest on whole small tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from syllabrook.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime.datetime | datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_stream_and_batch_of_failures_agree(spark):
    batch = QUERIES["login_lockout"](spark, FOLDER).collect()
    stream = QUERIES["login_lockout_stream"](spark, FOLDER).select("user_id", "gravadas", "bloqueios", "ignoradas").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))


def test_no_python_or_product_in_plans(spark):
    for name in sorted(SQL):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan, name
