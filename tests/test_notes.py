from pyspark.sql import functions as F

from tidemark.functions import rendering
from tidemark.operators import cutoffs, notes, stats

DAY = 86_400_000


def test_merge(spark):
    log = spark.createDataFrame([(1, 10, "npm:x", "Use the flag!", "tip"), (2, 20, "NPM x", "use THE flag", "gotcha"), (3, 5, "npm:x", "other", "tip"), (4, 9, "https://a.b/c/", "use the flag", "tip"), (5, 9, None, None, None)], "seq long, at_ms long, target string, text string, kind string")
    got = {(r.note_id, r.votes, r.text) for r in notes.merged_notes(log).collect()}
    assert {(1, 2, "Use the flag!"), (3, 1, "other"), (4, 1, "use the flag"), (5, 1, None)} == got


def test_rank(spark):
    rows = spark.createDataFrame([(1, "t", 0, "a"), (2, "t", 30 * DAY, "b"), (3, "t", 30 * DAY, "c"), (4, "t", 30 * DAY, "d"), (5, "t", 30 * DAY, "e")], "note_id long, target_key string, at_ms long, text string")
    log = [(1, "vote")] * 8 + [(2, "vote")] * 5 + [(3, "flag")] * 6 + [(4, "flag")] * 3
    counts = notes.reactions(spark.createDataFrame(log, "note_id long, action string"))
    ranked = notes.ranked_notes(rows, counts, 30 * DAY)
    # 8 votes a half-life old weigh 4; notes at -3 or with 5 flags are hidden
    assert [(r.note_id, r.rank) for r in ranked.orderBy("rank").collect()] == [(2, 1), (1, 2), (5, 3)]
    assert [r.note_id for r in notes.recalled(ranked, 1).collect()] == [2]


def test_stale(spark):
    rows = spark.createDataFrame([(1, "u:p", "OLD"), (2, "u:p", "CUR"), (3, "u:p", None), (4, "u:q", "OLD")], "note_id long, target_key string, pin_hash string")
    now = spark.createDataFrame([("p", "CUR")], "url_hash string, content_hash string")
    assert {r.note_id: r.stale for r in notes.marked_stale(rows, now).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.note_id: r.pin_hash for r in notes.pinned(rows.drop("pin_hash"), now).collect()} == {1: "CUR", 2: "CUR", 3: "CUR", 4: None}


def test_cutoffs(spark):
    df = spark.createDataFrame([("Claude-Opus-4-8",), ("claude-opus-4",), ("gpt-4o-mini",), ("zzz",), (None,)], "m string")
    assert [r[0] for r in df.select(cutoffs.cutoff_of("m")).collect()] == ["2026-01-01", "2025-10-01", "2024-06-01", None, None]
    df = spark.createDataFrame([("2024-01-01", "x"), ("bad", "gpt-4"), (None, "gpt-4"), (None, "zz"), ("", "gpt-4")], "s string, m string")
    got = [tuple(r[0]) for r in df.select(cutoffs.since_ms(F.col("s"), F.col("m"))).collect()]
    assert got == [(1704067200000, None), (None, "invalid date"), (1693526400000, None), (None, "unknown model"), (1693526400000, None)]
    versions = spark.createDataFrame([("p", "a", 1), ("p", "b", 5), ("p", "c", 9)], "k string, d string, at long")
    assert [tuple(r) for r in cutoffs.changes_since(versions, "k", "d", "at", 1).collect()] == [("p", 2, "c")]
    assert cutoffs.registry(spark).count() == len(cutoffs.CUTOFFS)


def test_stats(spark):
    log = spark.createDataFrame([(1, "www.A.com. ", 10, True, 1), (1, "www.A.com. ", 10, True, 1), (2, None, -5, False, 2), (3, "b.org", None, None, 3), (4, "a.com", 2000, True, 4)], "seq long, domain string, saved long, hit boolean, at_ms long")
    row = stats.totals(log).first()
    assert (row.tokens_saved, row.hits, row.misses, row.mean_saved) == (2010, 2, 1, 670) and abs(row.hit_rate - 2 / 3) < 1e-12
    assert [tuple(r) for r in stats.leaders(log, 2).collect()] == [("a.com", 2010), ("b.org", 0)]
    assert [r.seq for r in stats.recent(log, 2).collect()] == [4, 3]
    empty = stats.totals(log.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0)
    assert '"tokens_saved":2010' in stats.stats_json(log).first().stats and '"top_domains":[{"member":"a.com","score":2010}' in stats.stats_json(log).first().stats
    df = spark.createDataFrame([(950,), (1249,), (1250,)], "n long")
    assert [r[0] for r in df.select(stats.short_count(F.col("n"))).collect()] == ["950", "1.2K", "1.3K"]


def test_rendering(spark):
    df = spark.createDataFrame([(True, False)], "y boolean, n boolean")
    y, n = F.col("y"), F.col("n")
    state = [rendering.fetch_state(*x) for x in ((y, n, n, n, n), (n, y, y, n, n), (n, n, y, y, n), (n, n, y, n, y), (n, n, n, n, n))]
    assert list(df.select(*(s.alias(f"s{i}") for i, s in enumerate(state))).first()) == ["unchanged", "hit (section delta)", "hit (revalidated)", "hit (alias)", "miss"]
    line = rendering.note_line(F.lit("tip"), F.lit("x"), F.lit(3), F.lit(7), y)
    assert df.select(rendering.notes_block(F.array(line))).first()[0].count("may be stale") == 1
    assert df.select(rendering.notes_block(F.array().cast("array<string>"))).first()[0] == ""
    assert df.select(rendering.changes_line(F.lit(0), F.lit("h"))).first()[0] is None
