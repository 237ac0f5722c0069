"""Answers to fetch requests over the stored pages: whole, unchanged, by section, as a delta, or clipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text, urls
from tidemark.operators import sections
from tidemark.sources.scratch import Scratch


def page_of_requests(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requests with the page of their canonical address: columns url_hash, markdown, content_hash, original_tokens; null where none is stored.

    `pages` has a row a page: (url_hash, markdown, original_tokens).
    """
    keyed = requests.withColumn("url_hash", urls.url_hash(urls.canonical("url")["canonical_url"]))
    stored = pages.select("url_hash", "markdown", "original_tokens", text.content_hash("markdown").alias("content_hash"))
    return keyed.join(stored, "url_hash", "left")


def deltas(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(url_hash, known_hash, delta, changed, total): what changed in each page since the text that the known hash stands for.

    `pairs` has distinct (url_hash, known_hash), `before` texts (url_hash, known_hash, markdown), equal ones more than once at times,
    of which only those asked for are moved, `after` one a page (url_hash, markdown). Sections meet by heading in a join, so the work is linear in their number; of equal headings
    before, the last counts. However many requests ask for a pair, it is worked out once.
    """
    keys = ["url_hash", "known_hash"]
    old = sections.split_sections(before.join(pairs, keys, "left_semi").groupBy(*keys).agg(F.min("markdown").alias("markdown")), *keys)
    new = sections.split_sections(pairs.join(after.select("url_hash", "markdown"), "url_hash"), *keys)
    diff = sections.diff_indexes(old, new, *keys)
    counts = sections.delta_counts(diff, *keys).select(*keys, (F.col("changed") + F.col("added")).alias("changed"), "total")
    return counts.join(sections.delta_text(diff, *keys), keys, "left").select(*keys, F.coalesce("delta", F.lit("")).alias("delta"), "changed", "total")


def fetch_view(requests: DataFrame, pages: DataFrame, saves: DataFrame) -> DataFrame:
    """(request_id, state, markdown, tokens, saved, content_hash, sections_changed, sections_total).

    `requests` has (request_id, url, known_hash, section, token_budget), the last three null or empty where not asked for;
    `saves` has earlier texts (url_hash, markdown). state is `missing` without a stored page; `unchanged` if the known hash is
    the page's; `delta` if it is that of an earlier save and no section is asked for; else `section` where the section is
    found, or `page`. Texts are clipped to the budget last. Repeated requests are answered each; equal earlier texts once.
    """
    joined = page_of_requests(requests.select("request_id", "url", "known_hash", "section", "token_budget"), pages)
    prior = saves.filter("markdown is not null").select("url_hash", text.content_hash("markdown").alias("known_hash"), "markdown")
    rows = joined.join(prior.select("url_hash", "known_hash", F.lit(True).alias("_prior")).distinct(), ["url_hash", "known_hash"], "left")
    section = F.when(F.col("section") != "", F.col("section"))
    found = F.when(section.isNotNull(), sections.find_section(sections.section_array("markdown"), section))
    is_delta = F.col("_prior").isNotNull() & section.isNull()
    state = (
        F.when(F.col("markdown").isNull(), "missing").when(F.col("known_hash").eqNullSafe(F.col("content_hash")), "unchanged").when(is_delta, "delta").when(found.isNotNull() & (found != ""), "section").otherwise("page")
    )
    body = F.when(F.col("state") == "section", F.col("found")).when(F.col("state") == "page", F.col("markdown"))
    # what is told without deltas is written, so that requests meet their pages once
    staged = rows.withColumn("state", state).withColumn("found", found).select(
        "request_id", "url_hash", "known_hash", "state", "content_hash", "original_tokens", F.col("token_budget").cast("long").alias("budget"), body.alias("body"), F.when(F.col("state") == "unchanged", text.estimate_tokens("markdown")).alias("whole")
    )
    staged = Scratch(requests.sparkSession, "answers").keep(staged, "staged")
    made = deltas(staged.filter("state = 'delta'").select("url_hash", "known_hash").distinct(), prior, pages)
    is_of_delta = F.col("state") == "delta"
    joined = staged.join(made, ["url_hash", "known_hash"], "left")
    answered = joined.withColumn("body", text.clip_to_budget(F.when(is_of_delta, F.col("delta")).otherwise(F.col("body")), F.col("budget")))
    returned = text.estimate_tokens("body")
    saved = F.when(F.col("state") == "missing", F.lit(0).cast("long")).otherwise(text.tokens_saved("original_tokens", returned))
    return answered.select(
        "request_id", "state", F.col("body").alias("markdown"), F.coalesce("whole", returned).alias("tokens"), F.coalesce("whole", saved).alias("saved"), "content_hash",
        F.when(is_of_delta, F.col("changed")).alias("sections_changed"), F.when(is_of_delta, F.col("total")).alias("sections_total"),
    )
