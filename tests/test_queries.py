"""Every registered query with SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, bool | int | str) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert columns and rows
        return
    found = duck.sql(SQL[name])
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
