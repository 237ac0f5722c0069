"""All queries of the subpackage against their SQL, or for rows, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def tables(smallest):
    con = duckdb.connect()
    for path in Path(smallest).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, smallest, tables, name):
    df = QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert len(rows) == len(set(map(repr, rows)))
    if name in ORACLE:
        other = tables.execute(ORACLE[name])
        at = [[d[0] for d in other.description].index(c) for c in columns]
        assert rows == sorted((tuple(r[i] for i in at) for r in other.fetchall()), key=repr)
