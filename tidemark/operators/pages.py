"""Page versions, freshness, and ownership of equal bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import body_hash, content_hash, estimate_tokens
from tidemark.operators.order import with_previous
from tidemark.operators.store import put_if_absent

# Freshness in milliseconds, growth of a confirmed page's freshness, and the size of an empty page.
DAY_MS = 86_400_000
TTL_MS, TTL_LEAST_MS, TTL_MOST_MS = DAY_MS, 3_600_000, 7 * DAY_MS
LEASE_GROWTH = 1.6
LOW_YIELD_TOKENS = 50
ALIAS_MS, OWNER_MS, INDEX_MS, LOW_YIELD_MS = DAY_MS, 90_000_000, 30 * DAY_MS, 21_600_000
RING = 20


def completed(pages: DataFrame) -> DataFrame:
    """Missing content and body hashes are computed; stored ones are kept as they stand."""
    return pages.withColumn("content_hash", F.coalesce("content_hash", content_hash("markdown"))).withColumn("body_hash", F.coalesce("body_hash", body_hash("markdown")))


def versions(saves: DataFrame, key: str, digest: str, at: str, seq: str) -> DataFrame:
    """(key, digest, at, seq): a row for each save whose digest differs from the save before; the first save is a version."""
    before = with_previous(saves.select(key, digest, at, seq), key, [at, seq], digest, "_before")
    return before.filter(F.col("_before").isNull() | (F.col("_before") != F.col(digest))).drop("_before")


def adaptive_ttl(history: DataFrame, key: str, at: str, ring: int = RING, shell: str | None = None) -> DataFrame:
    """(key, ttl_ms): half the mean positive gap between a page's newest versions, within bounds; a day where fewer than three versions or no gap tell.

    `shell` names a column that is true for versions that are application shells; a page with one among its newest keeps the day.
    """
    by = Window.partitionBy(key)
    newest = history.withColumn("_rank", F.row_number().over(by.orderBy(F.desc(at)))).filter(F.col("_rank") <= ring)
    gaps = newest.withColumn("_gap", F.col(at) - F.lag(at).over(by.orderBy(at)))
    mean = F.avg(F.when(F.col("_gap") > 0, F.col("_gap")))
    ttl = F.least(F.lit(TTL_MOST_MS), F.greatest(F.lit(TTL_LEAST_MS), F.floor(mean / 2 + 0.5)))
    tells = (F.count("*") >= 3) & mean.isNotNull() & ~(F.coalesce(F.max(shell), F.lit(False)) if shell else F.lit(False))
    return gaps.groupBy(key).agg(F.when(tells, ttl).otherwise(F.lit(TTL_MS)).cast("long").alias("ttl_ms"))


def is_fresh(created_at: Column, ttl_ms: Column, now: int | Column) -> Column:
    """Younger than its freshness, a day where none is set."""
    return (F.lit(now) if isinstance(now, int) else now) - created_at < F.coalesce(ttl_ms, F.lit(TTL_MS))


def grown_lease(ttl_ms: Column) -> Column:
    """Freshness of a page that its origin confirmed as unchanged."""
    return F.least(F.lit(TTL_MOST_MS), F.floor(F.coalesce(ttl_ms, F.lit(TTL_MS)) * LEASE_GROWTH + 0.5).cast("long"))


def may_share(tokens: Column, spa_partial: Column) -> Column:
    """Whether a body may own others: not a shell and not next to empty."""
    return (tokens >= LOW_YIELD_TOKENS) & ~F.coalesce(spa_partial, F.lit(False))


def low_yield(tokens: Column, spa_partial: Column) -> Column:
    """Why a page isn't worth fetching: `partial` or `near-empty`; null where it is."""
    return F.when(F.coalesce(spa_partial, F.lit(False)), "partial").when(tokens < LOW_YIELD_TOKENS, "near-empty")


def body_owners(pages: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """(body_hash, owner): the first page that had each body, among those that may share it."""
    able = pages.filter(may_share(estimate_tokens("markdown"), F.col("spa_partial"))).select(F.col("body_hash"), F.col(at), F.col(seq), F.col(key).alias("owner"))
    return put_if_absent(able, "body_hash", at, seq).select("body_hash", "owner")


def aliases(pages: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """(key, owner, body_hash) of pages that share another's body; a page is never its own alias."""
    able = pages.filter(may_share(estimate_tokens("markdown"), F.col("spa_partial"))).select(key, "body_hash").distinct()
    return able.join(owners, "body_hash").filter(F.col(key) != F.col("owner")).select(key, "owner", "body_hash")


def valid_aliases(links: DataFrame, pages: DataFrame, now: int) -> DataFrame:
    """Aliases whose owner is fresh and still has the body they were made for. `pages` has one row a key: (url_hash, body_hash, created_at, ttl_ms)."""
    owner = pages.select(F.col("url_hash").alias("owner"), F.col("body_hash").alias("_body"), "created_at", "ttl_ms")
    joined = links.join(owner, "owner").filter((F.col("_body") == F.col("body_hash")) & is_fresh(F.col("created_at"), F.col("ttl_ms"), now))
    return joined.select(*links.columns)


def equal_bodies(pages: DataFrame, text_col: str = "markdown") -> DataFrame:
    """(body_hash, pages): how many rows have each body; partial counts before the shuffle."""
    return pages.groupBy(body_hash(text_col).alias("body_hash")).agg(F.count("*").alias("pages"))


def redirected(starts: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """(url, final_url, hops, status): follows redirects, at most `most`; status is `ok`, `too many` or `no location`.

    `hops` has one row an address: (url, location); a null location is a redirect to nowhere. Bounded, so the joins are unrolled.
    """
    step = hops.select(F.col("url").alias("_from"), F.col("location").alias("_to"), F.lit(True).alias("_hop"))
    at = starts.select("url").withColumn("final_url", F.col("url")).withColumn("hops", F.lit(0)).withColumn("status", F.lit(None).cast("string"))
    for _ in range(most + 1):
        at = at.join(step, F.col("final_url") == F.col("_from"), "left")
        moving = F.col("status").isNull()
        at = at.select(
            "url",
            F.when(moving & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("final_url")).alias("final_url"),
            (F.col("hops") + F.when(moving & F.col("_to").isNotNull(), 1).otherwise(0)).alias("hops"),
            F.when(~moving, F.col("status")).when(F.col("_hop").isNull(), "ok").when(F.col("_to").isNull(), "no location").alias("status"),
        )
    return at.withColumn("status", F.coalesce("status", F.lit("too many")))
