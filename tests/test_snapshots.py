import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.snapshots import keep_snapshot, next_changes, snapshot_changes

SCHEMA = "snap_no int, url_hash string, heading string, body string, loaded_at long"


def brute(rows, numbers=None):
    held = {}
    for n, u, h, b, t in rows:
        key = (n, u, "(intro)" if h is None else h.strip().lower())
        form = "\n".join(line.rstrip(" \t\r") for line in (b or "").split("\n")).rstrip("\n")
        held[key] = max(held.get(key, (-1, "")), (-1 if t is None else t, form))
    numbers = numbers or sorted({k[0] for k in held})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        for key in {k[1:] for k in held if k[0] in (a, b)}:
            old, new = held.get((a, *key)), held.get((b, *key))
            if old is None or new is None or old[1] != new[1]:
                out.add((b, *key, "added" if old is None else "removed" if new is None else "changed"))
    return out


def changed(df, **more):
    return {tuple(r) for r in snapshot_changes(df, **more).collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), rng.choice(["p", "p", "q", "r"]), rng.choice([" A ", "a", "B", None, ""]), rng.choice(["x", "x \r\n", "y", None, "", "x\n\n", "z" * 3000]), i) for i in range(300)]
    assert changed(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert changed(spark.createDataFrame(rows + rows, SCHEMA)) == brute(rows)


def test_cases(spark):
    rows = [(1, "p", "A", "one", 1), (1, "p", "A", "two", 2), (2, "p", "a ", "two  \n", 1), (2, "p", "B", "", None), (4, "p", "A", "two", 1), (None, "p", "A", "x", 1), (1, None, "A", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert changed(df) == {(2, "p", "b", "added"), (4, "p", "b", "removed")}
    assert changed(df, numbers=[1, 2, 3, 4]) == {(2, "p", "b", "added"), (3, "p", "a", "removed"), (3, "p", "b", "removed"), (4, "p", "a", "added")}
    assert changed(df.limit(0)) == set()
    assert changed(df.withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))) == changed(df)
    # a later row holds whatever it says, and of rows loaded at once one is chosen the same way each time
    tie = spark.createDataFrame([(1, "p", "A", "x", 5), (1, "p", "A", "y", 5), (2, "p", "A", "x", 1), (2, "p", "A", "y", 1)], SCHEMA)
    assert changed(tie) == set()


def test_delivery_by_delivery(spark, tmp_path):
    """Each delivery against the kept one before it gives what all of them give together."""
    rng = random.Random(5)
    rows = [(rng.randint(1, 4), rng.choice("pqr"), rng.choice([" A ", "a", "B", None]), rng.choice(["x", "x \r\n", "y", None]), i) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = set()
    keep_snapshot(df.filter("snap_no = 1"), str(tmp_path / "1"))
    for n in (2, 3, 4):
        delivery = df.filter(F.col("snap_no") == n)
        got |= {tuple(r) for r in next_changes(spark.read.parquet(str(tmp_path / str(n - 1))), delivery).collect()}
        keep_snapshot(delivery, str(tmp_path / str(n)))
    assert got == brute(rows)
    kept = spark.read.parquet(str(tmp_path / "4"))
    assert kept.columns == ["url_hash", "heading", "snap_no", "digest"] and next_changes(kept, df.limit(0)).isEmpty()
    assert next_changes(kept.limit(0), df.filter("snap_no = 2")).isEmpty()
    for wrong in (df, df.filter("snap_no = 4")):
        with pytest.raises(ValueError):
            next_changes(kept, wrong)
