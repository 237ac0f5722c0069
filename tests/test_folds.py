import random

from pyspark.sql import functions as F

from tidemark.operators import demand, replay, windows
from tidemark.operators.pages import TTL_MS
from tidemark.sources.feeds import release_times


def sequential(rows, window, limit):
    """One client after the other, one request after the other."""
    out, state = {}, {}
    for client, at, seq in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, closes = state.get(client, (0, 0))
        if client not in state or closes <= at:
            n, closes = 0, at + window
        state[client] = (n + 1, closes)
        out[seq] = (n + 1, n + 1 <= limit)
    return out


def test_windows_against_the_sequential_model(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", "c"]), rng.randint(0, 3000), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "client string, at_ms long, seq long")
    got = {r.seq: (r.n, r.allowed) for r in windows.anchored_counts(df, 50, 3).collect()}
    assert got == sequential(rows, 50, 3)
    assert windows.anchored_counts(df.limit(0), 50, 3).isEmpty()
    odd = spark.createDataFrame([(None, 5, 1), (None, 6, 2), ("x", None, 3)], "client string, at_ms long, seq long")
    assert {(r.client, r.seq, r.n) for r in windows.anchored_counts(odd, 50, 1).collect()} == {("anon", 1, 1), ("anon", 2, 2)}


def test_replay(spark):
    day = TTL_MS
    rows = [("p", 0, 1, "a"), ("p", 10, 2, "b"), ("p", day, 3, None), ("p", day + 5, 4, "b"), ("p", 5 * day, 5, "b"), ("q", 0, 6, None), ("q", None, 7, "x")]
    got = {r.seq: (r.state, r.ttl_ms) for r in replay.replay(spark.createDataFrame(rows, "url_hash string, at_ms long, seq long, digest string")).collect()}
    assert got == {1: ("miss", day), 2: ("hit", day), 3: ("revalidated", int(1.6 * day)), 4: ("hit", int(1.6 * day)), 5: ("miss", day), 6: ("miss", day)}


def test_first_after(spark):
    rng = random.Random(2)
    starts = [(rng.choice("ab"), rng.randint(0, 1000)) for _ in range(80)] + [("a", None)]
    events = [(rng.choice("ab"), rng.randint(0, 1200)) for _ in range(200)] + [("b", None), (None, 4)]
    s = spark.createDataFrame(starts, "k string, start_at long")
    e = spark.createDataFrame(events, "k string, at_ms long")
    got = {(r.k, r.start_at): r.first_at for r in demand.first_after(s, e, 30, "k").collect()}
    assert got == {(k, a): min((t for x, t in events if x == k and t is not None and a is not None and a < t <= a + 30), default=None) for k, a in starts}


def test_percentiles(spark):
    df = spark.createDataFrame([("g", x) for x in (4, 1, 3, 2)] + [("n", None)], "g string, x long")
    got = {r.g: (r.a, r.b) for r in demand.ranked_percentiles(df, ["g"], "x", [50, 90]).withColumnsRenamed({"p50": "a", "p90": "b"}).collect()}
    assert got == {"g": (3, 4)}
    found = spark.createDataFrame([("g", 0, 4), ("g", 0, 1), ("g", 0, 3), ("g", 0, 2), ("g", 0, None), ("n", 0, None)], "g string, start_at long, first_at long")
    rows = {r.g: (r.starts, r.followed, r.p50_ms, r.p90_ms, r.share) for r in demand.lead_times(found, "g").collect()}
    assert rows == {"g": (5, 4, 3, 4, 0.8), "n": (1, 0, None, None, 0.0)}
    assert tuple(demand.lead_times(found).select("starts", "followed", "p50_ms").first()) == (6, 4, 3)


def test_feeds(spark):
    bodies = [("npm", "a", '{"time":{"created":"2024-01-01T00:00:00Z","1.0":"2024-02-01T00:00:00Z","x":"bad"}}'), ("pypi", "b", '{"releases":{"1":[{"upload_time_iso_8601":"2024-02-01T00:00:00Z"}],"2":[]}}'), ("github", "c", '[{"published_at":"2024-03-01T00:00:00Z"},{}]'), ("npm", "x", "bad"), ("pypi", "y", None)]
    got = {(r.id, r.at_ms) for r in release_times(spark.createDataFrame(bodies, "type string, id string, body string")).collect()}
    assert got == {("a", 1706745600000), ("b", 1706745600000), ("c", 1709251200000)}


def test_demand(spark):
    events = spark.createDataFrame([(1, "https://a.b/x/1", 5), (1, "https://a.b/x/1", 5), (2, "https://a.b/x/2", 9), (3, None, 1)], "seq long, url string, at_ms long")
    assert {(r.docset, r.n) for r in demand.frequency(events).collect()} == {("a.b/x", 2), ("unknown", 1)}
    assert {(r.docset, r.url) for r in demand.sample_urls(events).collect()} == {("a.b/x", "https://a.b/x/2")}
    assert demand.frequency(events.withColumn("docset", F.lit("clash"))).count() == 2
