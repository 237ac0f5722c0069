"""Community notes: merging, ranking by decayed trust, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import dedup_form
from tidemark.functions.urls import target_key

# When a note is hidden, and how fast trust fades.
HIDE_NET, HIDE_FLAGS, HALF_LIFE_DAYS = -3, 5, 30
RING = 50


def merged_notes(log: DataFrame) -> DataFrame:
    """(note_id, target_key, text, kind, at_ms, votes): notes on one target with one normal form are one note with a vote each.

    `log` has (seq, at_ms, target, text, kind). The earliest row gives id, text, kind and time; every row is a vote. Exact as long as
    a target's live notes fit the ring of 50; the partial minimum and count run before the shuffle.
    """
    keyed = log.select(target_key("target").alias("target_key"), dedup_form("text").alias("_form"), F.struct("at_ms", "seq", F.substring("text", 1, 500).alias("text"), "kind").alias("_row"))
    return keyed.groupBy("target_key", "_form").agg(F.min("_row").alias("r"), F.count("*").alias("votes")).select(
        F.col("r.seq").alias("note_id"), "target_key", F.col("r.text").alias("text"), F.col("r.kind").alias("kind"), F.col("r.at_ms").alias("at_ms"), "votes"
    )


def reactions(votes: DataFrame) -> DataFrame:
    """(note_id, votes, flags) of a log (note_id, action in vote, flag)."""
    return votes.groupBy("note_id").agg(F.count_if(F.col("action") == "vote").alias("votes"), F.count_if(F.col("action") == "flag").alias("flags"))


def visible(net: Column, flags: Column) -> Column:
    return (net > HIDE_NET) & (flags < HIDE_FLAGS)


def ranked_notes(notes: DataFrame, counts: DataFrame, now: int) -> DataFrame:
    """Visible notes of each target with live votes, flags, net and rank by net score halved every 30 days, newer first among equals.

    `notes` has (note_id, target_key, at_ms, ...); a note without reactions has none. Only the newest 50 of a target are ranked.
    """
    ring = notes.withColumn("_rank", F.row_number().over(Window.partitionBy("target_key").orderBy(F.desc("at_ms"), F.desc("note_id")))).filter(F.col("_rank") <= RING).drop("_rank", "votes", "flags")
    zero = F.lit(0).cast("long")
    live = ring.join(counts, "note_id", "left").withColumn("votes", F.coalesce("votes", zero)).withColumn("flags", F.coalesce("flags", zero)).withColumn("net", F.col("votes") - F.col("flags"))
    weight = F.col("net") * F.pow(F.lit(0.5), (F.lit(now) - F.col("at_ms")) / 86_400_000 / HALF_LIFE_DAYS)
    order = Window.partitionBy("target_key").orderBy(F.desc("weight"), F.desc("at_ms"), F.desc("note_id"))
    return live.filter(visible(F.col("net"), F.col("flags"))).withColumn("weight", weight).withColumn("rank", F.row_number().over(order))


def recalled(ranked: DataFrame, limit: int = 12) -> DataFrame:
    """The first notes of each target; the limit is the report's."""
    return ranked.filter(F.col("rank") <= limit)


def pinned(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Notes on addresses with the content hash that their page has; `pages` has a row a page: (url_hash, content_hash)."""
    return notes.join(pages.select(F.concat(F.lit("u:"), "url_hash").alias("target_key"), F.col("content_hash").alias("pin_hash")), "target_key", "left")


def marked_stale(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds `stale`: pinned to another content than the page has now. Without a pin or a page nothing is stale."""
    current = pages.select(F.concat(F.lit("u:"), "url_hash").alias("target_key"), F.col("content_hash").alias("_current"))
    return notes.join(current, "target_key", "left").withColumn("stale", F.coalesce(F.col("pin_hash") != F.col("_current"), F.lit(False))).drop("_current")
