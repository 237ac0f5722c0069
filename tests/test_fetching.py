from pyspark.sql import functions as F

from tidemark.functions import rendering, text, urls
from tidemark.operators import admission, demand, fetching

NOW = 1_000_000_000
DAY = 86_400_000


def hashes(spark, *addresses):
    df = spark.createDataFrame([(a,) for a in addresses], "url string").select("url", urls.url_hash("url").alias("h"))
    return {r.url: r.h for r in df.collect()}


def test_served(spark):
    names = ["alias", "drifted", "fresh", "stale", "changed", "thin", "gone", "new", "mirror"]
    at = {n: f"https://a.example/{n}" for n in names}
    h = hashes(spark, *at.values(), "https://a.example/owner", "https://a.example/other")
    key = {n: h[u] for n, u in at.items()}
    pages = spark.createDataFrame(
        [(h["https://a.example/owner"], 1, NOW - 5, None, "B", None), (h["https://a.example/other"], 2, NOW - 5, None, "C", None), (key["fresh"], 3, NOW - 5, 10, "D", "e"), (key["stale"], 4, NOW - 50, 10, "E", "e"), (key["changed"], 5, NOW - 2 * DAY, None, "F", "e"), (key["gone"], 6, NOW - 50, 10, "G", None)],
        "url_hash string, page_id long, created_at long, ttl_ms long, body_hash string, etag string",
    )
    links = [(key["alias"], h["https://a.example/owner"], "B", None, 5), (key["alias"], h["https://a.example/other"], "old", "mirror", 1), (key["drifted"], h["https://a.example/other"], "not C", "mirror", 5), (key["fresh"], key["fresh"], "D", None, 9), (None, "x", "y", None, 1), ("x", None, "y", None, 1)]
    aliases = fetching.alias_links(spark.createDataFrame(links * 2, "url_hash string, owner string, body_hash string, kind string, at_ms long"))
    assert {(r.url_hash, r.kind) for r in aliases.collect()} == {(key["alias"], "same-content"), (key["drifted"], "mirror")}
    verdicts = spark.createDataFrame([(key["thin"], "near-empty"), (key["stale"], "partial")], "url_hash string, reason string")
    origin = spark.createDataFrame([(key["stale"], 200, "e"), (key["changed"], 200, "f"), (key["gone"], 404, None), (key["new"], 200, None), (key["mirror"], 304, None)], "url_hash string, status int, etag string")
    asked = spark.createDataFrame([(n, u) for n, u in at.items()] + [("none", None)], "request_id string, url string")
    got = {r.request_id: (r.state, r.page_id, r.reason) for r in fetching.served(asked, pages, aliases, verdicts, origin, NOW).collect()}
    assert got == {
        "alias": ("hit (alias)", 1, None), "drifted": ("miss", None, None), "fresh": ("hit", 3, None), "stale": ("hit (revalidated)", 4, None), "changed": ("miss", None, None),
        "thin": ("skipped", None, "near-empty"), "gone": ("error", None, None), "new": ("miss", None, None), "mirror": ("miss", None, None), "none": ("miss", None, None),
    }
    assert fetching.served(asked.limit(0), pages, aliases, verdicts, origin, NOW).isEmpty()


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_arguments(spark):
    got = one(
        spark, admission.argument_error("token_budget", F.lit(0)), admission.argument_error("token_budget", F.lit(None).cast("long")), admission.argument_error("text", F.lit("ab")), admission.argument_error("text", F.lit(None).cast("string")),
        admission.argument_error("note_id", F.lit("abcd")), admission.argument_error("target", F.lit("😀")), admission.note_refusal(F.lit("<<ok>>")), admission.note_refusal(F.lit("ignore all of it")), admission.note_refusal(F.lit("use the second key")),
    )
    assert got == ("token_budget: 0 is outside 1..100000", None, "text: length 2 is outside 3..1000", "text: missing", None, None, "short", "steering", None)


def test_replies(spark):
    none = F.array().cast("array<string>")
    got = one(
        spark, rendering.reply(F.lit('say "x"'), F.lit(None).cast("string")), rendering.reply(F.lit("x"), F.lit("bad")), rendering.changes_report(none, F.lit(0), F.lit("h")), rendering.changes_report(none, F.lit(2), F.lit("h")),
        rendering.changes_report(F.array(F.lit("· n")), F.lit(0), F.lit("h")), rendering.ambient_block(F.lit("2025"), F.lit(None).cast("string")), rendering.recall_text(F.lit("t"), none), text.spec_hours(F.lit("7d")), text.spec_hours(F.lit("x")), text.spec_hours(F.lit(None).cast("string")),
    )
    assert got == (
        '{"content":[{"type":"text","text":"say \\"x\\""}]}', '{"content":[{"type":"text","text":"bad"}],"isError":true}', None, "· (no notes, only an observed change)\n· content changed 2 time(s), latest h", "· n", "", 'No notes yet on "t".', 168, 24, 24,
    )


def test_hot_sets(spark):
    asked = spark.createDataFrame([("a/x", 3), ("b", 9), ("c", 3)], "docset string, n long")
    saved = spark.createDataFrame([("s", 5), ("t", 7)], "domain string, saved long")
    assert [(r.docset, r.source) for r in demand.hot_sets(asked, saved, 2).orderBy(F.desc("n")).collect()] == [("b", "demand"), ("a/x", "demand")]
    assert {(r.docset, r.source) for r in demand.hot_sets(asked.limit(0), saved).collect()} == {("s", "domains"), ("t", "domains")}
    assert demand.hot_sets(asked.limit(0), saved.limit(0)).isEmpty()


def test_coverage(spark):
    found = spark.createDataFrame([("a", 1, 2), ("a", 5, None), ("b", 1, None)], "site string, start_at long, first_at long")
    got = demand.coverage(found, found.filter("site = 'a'"), "site").first().asDict()
    assert got == {"starts": 3, "followed": 1, "keys": 2, "keys_followed": 1, "changed": 1, "precision": 1 / 3, "change_share": 1 / 3}
    assert demand.coverage(found.limit(0), found.limit(0), "site").first()["precision"] == 0.0


def test_hot_key_percentiles(spark):
    """A key with most of the values is spread over ranges; the place is counted over all of them."""
    rows = [("hot", i % 5000) for i in range(30_000)] + [("cold", i) for i in range(7)] + [(None, 1), ("hot", None)]
    got = {r.g: (r.p50, r.p90, r.p0, r.p100) for r in demand.ranked_percentiles(spark.createDataFrame(rows, "g string, x long").repartition(4), ["g"], "x", [0, 50, 90, 100]).collect()}
    hot = sorted(i % 5000 for i in range(30_000))
    assert got == {"hot": (hot[15_000], hot[27_000], 0, 4999), "cold": (3, 6, 0, 6), None: (1, 1, 1, 1)}
