from pyspark.sql import functions as F

from tidemark.operators import pages, store

H = 3_600_000


def test_store_views(spark):
    log = spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 1, "y"), ("b", 5, 2, None), (None, 1, 3, "n"), ("a", 2, 1, "y")], "k string, at long, seq long, v string")
    assert {(r.k, r.v) for r in store.latest(log, "k", "at", "seq").collect()} == {("a", "y"), ("b", None), (None, "n")}
    assert {(r.k, r.v) for r in store.put_if_absent(log, "k", "at", "seq").collect()} == {("a", "x"), ("b", None), (None, "n")}
    assert [r.seq for r in store.newest(log.distinct(), 2, "at", "seq").collect()] == [2, 1]
    assert sorted(r.seq for r in store.newest(log.distinct(), 1, "at", "seq", keys=("k",)).collect()) == [1, 2, 3]
    assert {r.k for r in store.live(log, "at", 3, 5).collect()} == {"b"}
    assert {r.k for r in store.delete(log, spark.createDataFrame([("a",)], "k string"), "k").collect()} == {"b", None}
    counts = store.counters(log, "k")
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {(r.k, r.n) for r in store.read_counter(keys, counts, "k").collect()} == {("a", 3), ("z", 0)}
    assert store.counters(spark.createDataFrame([(1.5,), (None,), (2.4,)], "x double"), amount="x").first().n == 4
    empty = log.limit(0)
    assert store.latest(empty, "k", "at").isEmpty() and store.counters(empty, "k").isEmpty()


def test_ring_and_ties(spark):
    scores = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9)], "m string, s long")
    assert [r.m for r in store.top_members(scores, "m", "s", 2).collect()] == ["c", "a"]


def test_versions(spark):
    saves = spark.createDataFrame([("p", "x", 1, 1), ("p", "x", 2, 2), ("p", "y", 3, 3), ("p", "x", 4, 4), ("q", "z", 1, 5)], "k string, d string, at long, seq long")
    assert {(r.k, r.at) for r in pages.versions(saves, "k", "d", "at", "seq").collect()} == {("p", 1), ("p", 3), ("p", 4), ("q", 1)}


def test_adaptive_ttl(spark):
    data = [("few", 0), ("few", H)] + [("fast", i * 60_000) for i in range(5)] + [("mid", i * 10 * H) for i in range(5)] + [("slow", i * 10_000 * H) for i in range(4)] + [("same", 7)] * 4
    got = {r.k: r.ttl_ms for r in pages.adaptive_ttl(spark.createDataFrame(data, "k string, at long"), "k", "at").collect()}
    assert got == {"few": 24 * H, "fast": H, "mid": 5 * H, "slow": 7 * 24 * H, "same": 24 * H}


def test_freshness(spark):
    df = spark.createDataFrame([(0, H), (0, None), (0, 30 * H)], "c long, t long")
    assert [r[0] for r in df.select(pages.is_fresh(F.col("c"), F.col("t"), 24 * H)).collect()] == [False, False, True]
    assert [r[0] for r in df.select(pages.grown_lease(F.col("t"))).collect()] == [round(1.6 * H), round(38.4 * H), 48 * H]


def test_bodies(spark):
    long = "x" * 400
    saves = spark.createDataFrame([("a", long, 1, 1, None), ("b", long, 2, 2, None), ("c", long, 0, 3, True), ("d", "tiny", 1, 4, None), ("e", None, 1, 5, None), ("b", long, 3, 6, False)], "k string, markdown string, at long, seq long, spa_partial boolean")
    saves = saves.withColumn("body_hash", F.sha2("markdown", 256))
    owners = pages.body_owners(saves, "k", "at", "seq")
    assert [r.owner for r in owners.collect()] == ["a"]
    links = pages.aliases(saves, owners, "k")
    assert [(r.k, r.owner) for r in links.collect()] == [("b", "a")]
    current = spark.createDataFrame([("a", saves.first().body_hash, 0, H)], "url_hash string, body_hash string, created_at long, ttl_ms long")
    assert pages.valid_aliases(links, current, 10).count() == 1 and pages.valid_aliases(links, current, H).isEmpty()
    assert pages.valid_aliases(links, current.withColumn("body_hash", F.lit("other")), 10).isEmpty()
    assert {r.pages for r in pages.equal_bodies(saves).collect()} == {4, 1}
    df = spark.createDataFrame([(10, True), (10, None), (60, False)], "t long, s boolean")
    assert [r[0] for r in df.select(pages.low_yield(F.col("t"), F.col("s"))).collect()] == ["partial", "near-empty", None]


def test_redirects(spark):
    hops = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(5)] + [("x", "y"), ("y", "x"), ("n", None)], "url string, location string")
    starts = spark.createDataFrame([("r0",), ("x",), ("n",), ("plain",), (None,)], "url string")
    got = {r.url: (r.final_url, r.hops, r.status) for r in pages.redirected(starts, hops).collect()}
    assert got["r0"] == ("r5", 5, "ok") and got["plain"] == ("plain", 0, "ok") and got["n"] == ("n", 0, "no location") and got["x"][2] == "too many" and got[None] == (None, 0, "ok")


def test_completed(spark):
    df = spark.createDataFrame([("a", None, None), ("a", "K", "L")], "markdown string, content_hash string, body_hash string")
    got = pages.completed(df).collect()
    assert len(got[0].content_hash) == 16 and len(got[0].body_hash) == 64 and (got[1].content_hash, got[1].body_hash) == ("K", "L")


def test_shells_keep_the_default(spark):
    rows = [("a", 3_600_000 * 10 * k, k == 2) for k in range(4)] + [("b", 3_600_000 * 10 * k, None) for k in range(4)]
    df = spark.createDataFrame(rows, "k string, at long, shell boolean")
    assert {r.k: r.ttl_ms for r in pages.adaptive_ttl(df, "k", "at", shell="shell").collect()} == {"a": pages.TTL_MS, "b": 5 * 3_600_000}
    assert {r.ttl_ms for r in pages.adaptive_ttl(df, "k", "at").collect()} == {5 * 3_600_000}
