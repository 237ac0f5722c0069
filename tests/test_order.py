import random

from pyspark.sql import functions as F

from tidemark.operators.order import with_previous


def test_against_a_sorted_list(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randint(0, 300), i, rng.choice(["x", "y", None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at long, seq long, v string").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: r.prev for r in with_previous(df, "k", ["at", "seq"], "v", "prev").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    expected = {}
    for k in {"hot", "a", "b"}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        expected |= {r[2]: p for r, p in zip(own, [None, *(r[3] for r in own)])}
    assert got == expected | {r[2]: None for r in rows if r[0] is None}


def test_cases(spark):
    df = spark.createDataFrame([(1, 5, 0, 7)], "k long, at long, seq long, v int")
    assert [tuple(r) for r in with_previous(df, "k", ["at", "seq"], "v", "prev").collect()] == [(1, 5, 0, 7, None)]
    assert with_previous(df.limit(0), "k", ["at", "seq"], "v", "prev").isEmpty()
    clash = with_previous(df.withColumn("before", F.lit("x")), "k", ["at"], "at", "prev")
    assert clash.columns == ["k", "at", "seq", "v", "before", "prev"]
