"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from plantspark.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p if Path(p).is_file() else p + '/*.parquet'}')")
    return con


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(tuple(shown(r[c]) for c in columns) for r in df.collect())
    rows = duck.execute(SQL[name])
    theirs = [x[0] for x in rows.description]
    assert sorted(theirs) == columns
    assert found == Counter(tuple(shown(r[theirs.index(c)]) for c in columns) for r in rows.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
