import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import p6_frequent as P

SCHEMA = "seq long, url string, domain string"


def sample(n=3000):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        url = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]) if rng.random() < 0.1 else f"u{i}"
        rows.append((i, url, rng.choice(["x", "x", "y", None, "unknown"])))
    return rows


def brute(rows, shares):
    rows = list({r[0]: r for r in rows}.values())
    out = set()
    for k, f in enumerate(("url", "domain"), 1):
        for v, n in Counter(r[k] for r in rows if r[k] is not None).items():
            if f in shares and n >= len(rows) * shares[f]:
                out.add((f, v, n, len(rows)))
    return out


def test_against_brute_force(spark):
    rows = sample()
    shares = {"url": 0.004, "domain": 0.02}
    df = spark.createDataFrame(rows + rows[:700], SCHEMA).repartition(7)
    assert {tuple(r) for r in P.heavy_hitters(df, shares).collect()} == brute(rows, shares)
    top = [tuple(r) for r in P.top_k(df, "url", 4).collect()]
    counts = Counter(r[1] for r in rows if r[1] is not None)
    assert top == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
    assert [r.value for r in P.top_k(df, "url", 7).collect()] == [v for v, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:7]]  # ties by value


def test_threshold_is_exact(spark):
    rows = [(i, "v" if i < 4 else None, None) for i in range(1000)]
    assert [tuple(r) for r in P.heavy_hitters(spark.createDataFrame(rows, SCHEMA), {"url": 0.004}).collect()] == [("url", "v", 4, 1000)]
    rows.append((1000, None, None))
    assert P.heavy_hitters(spark.createDataFrame(rows, SCHEMA), {"url": 0.004}).isEmpty()


def test_cases(spark):
    df = spark.createDataFrame([(1, "", "d"), (None, "", None), (None, "", None), (2, "x" * 200_000, None)], SCHEMA)
    got = {(r.field, len(r.value), r.n, r.total) for r in P.heavy_hitters(df, {"url": 0.5, "domain": 0.1}).collect()}
    assert got == {("url", 0, 2, 3), ("domain", 1, 1, 3)}
    assert P.heavy_hitters(df.limit(0), {"url": 0.5}).isEmpty() and P.top_k(df.limit(0), "url", 3).isEmpty()
    clash = df.withColumns({c: F.lit("x") for c in ("field", "value", "n", "v", "total")})
    assert P.heavy_hitters(clash, {"url": 0.5}).count() == 1


def test_runs_go_on_over_batches():
    values = ["a"] * 5 + ["b"] + ["c"] * 6
    batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * len(v)), pa.array(v)], ["field", "value"]) for v in (values[:3], values[3:3], values[3:4], values[4:9], values[9:])]
    got = [(v, n) for b in P._runs(iter(batches)) for v, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert got == [("a", 5), ("b", 1), ("c", 6)] and list(P._runs(iter([]))) == []


def test_runs_are_merged(spark):
    runs = [("a", 5), ("a", 2), ("b", 1), ("b", 4), ("b", 1), ("c", 3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * len(r), pa.string()), pa.array([v for v, _ in r], pa.string()), pa.array([n for _, n in r], pa.int64())], ["field", "value", "n"]) for r in (runs[:1], runs[1:4], [], runs[4:])]
    got = [(v, n) for b in P._runs(iter(batches)) for v, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert got == [("a", 7), ("b", 6), ("c", 3)]
    df = P.run_lengths(spark.createDataFrame([("f", f"v{i % 7}") for i in range(100)], "field string, value string").repartition(5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "Sort [" in plan and "Aggregate" not in plan
    assert {r.value: r.n for r in df.collect()} == {f"v{i}": 15 if i < 2 else 14 for i in range(7)}
