"""What a fetch of an address meets: an alias, a page, a verdict, or the origin.

Requests meet each view in one equi-join by hash; every view has one row a hash, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import urls
from tidemark.operators.pages import INDEX_MS, is_fresh
from tidemark.operators.store import latest, live

SAME = "same-content"


def alias_links(links: DataFrame) -> DataFrame:
    """(url_hash, at_ms, body_hash, kind, owner): the newest link of each address; none to itself; a null kind is `same-content`.

    Links without an address or owner are none. Of links of one time the greatest holds.
    """
    known = links.filter(F.col("url_hash").isNotNull() & F.col("owner").isNotNull() & (F.col("url_hash") != F.col("owner")))
    return latest(known.select("url_hash", "at_ms", "body_hash", F.coalesce("kind", F.lit(SAME)).alias("kind"), "owner"), "url_hash", "at_ms", "body_hash", "kind", "owner")


def outcome_of_crawl(status: Column, stored_etag: Column, etag: Column) -> Column:
    """`error` from 400 on; `not modified` for 304 and for an answer with the stored page's mark; else, and where no answer is known, `new`."""
    return F.when(status >= 400, "error").when((status == 304) | F.coalesce(stored_etag == etag, F.lit(False)), "not modified").otherwise("new")


def served(requests: DataFrame, pages: DataFrame, aliases: DataFrame, verdicts: DataFrame, origin: DataFrame, now: int) -> DataFrame:
    """(request_id, state, page_id, reason): which stored page answers each request, and how.

    `requests` has (request_id, url), `pages` (url_hash, page_id, created_at, ttl_ms, body_hash, etag), `aliases` the rows of
    alias_links, `verdicts` (url_hash, reason) that hold, `origin` (url_hash, status, etag), what the origin would answer.
    In this order: the fresh owner of an alias that still has its body is a `hit (alias)`; a fresh page a `hit`; an address
    without a page but with a verdict is `skipped`; a page that the origin confirms is a `hit (revalidated)`; an answer of 400 or
    more is an `error`; all else is a `miss`. Addresses are hashed as they stand for aliases and canonical for pages.
    """
    keyed = requests.select("request_id", urls.url_hash("url").alias("_asked"), urls.url_hash(urls.canonical("url")["canonical_url"]).alias("url_hash"))
    own = pages.select("url_hash", "page_id", is_fresh(F.col("created_at"), F.col("ttl_ms"), now).alias("_fresh"), "etag")
    owner = pages.select(F.col("url_hash").alias("owner"), F.col("page_id").alias("_owner_page"), F.col("body_hash").alias("_owner_body"), is_fresh(F.col("created_at"), F.col("ttl_ms"), now).alias("_owner_fresh"))
    linked = aliases.select(F.col("url_hash").alias("_asked"), "owner", "body_hash").join(owner, "owner").filter("_owner_fresh and _owner_body = body_hash").select("_asked", "_owner_page")
    answers = origin.select("url_hash", F.col("status").alias("_status"), F.col("etag").alias("_etag"))
    joined = keyed.join(linked, "_asked", "left").join(own, "url_hash", "left").join(verdicts.select("url_hash", F.col("reason").alias("_reason")), "url_hash", "left").join(answers, "url_hash", "left")
    crawl = outcome_of_crawl(F.col("_status"), F.col("etag"), F.col("_etag"))
    stored = F.col("page_id").isNotNull()
    state = (
        F.when(F.col("_owner_page").isNotNull(), "hit (alias)").when(stored & F.col("_fresh"), "hit").when(~stored & F.col("_reason").isNotNull(), "skipped")
        .when(crawl == "error", "error").when(stored & (crawl == "not modified"), "hit (revalidated)").otherwise("miss")
    )
    told = joined.withColumn("state", state)
    page = F.when(F.col("state") == "hit (alias)", F.col("_owner_page")).when(F.col("state").isin("hit", "hit (revalidated)"), F.col("page_id"))
    return told.select("request_id", "state", page.alias("page_id"), F.when(F.col("state") == "skipped", F.col("_reason")).alias("reason"))


def prior_indexes(versions: DataFrame, now: int, hold_ms: int = INDEX_MS) -> DataFrame:
    """(url_hash, digest, replaced_at): contents that a later version replaced, whose index is still kept. `versions` has (url_hash, digest, at, until)."""
    return live(versions.filter("until is not null").select("url_hash", "digest", F.col("until").alias("replaced_at")), "replaced_at", hold_ms, now)
