"""All queries of the core against their SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def tables(smallest):
    con = duckdb.connect()
    for path in Path(smallest).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, smallest, tables, name):
    df = QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLE:
        other = tables.execute(ORACLE[name])
        at = [[d[0] for d in other.description].index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["domain", "saved"] and not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
