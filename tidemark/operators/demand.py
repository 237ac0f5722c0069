"""Demand, release feeds and the lead time between a release and what follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.urls import Address, doc_set, with_address
from tidemark.operators.store import top_members
from tidemark.sources.scratch import Scratch

HOUR_MS = 3_600_000
# Package feeds of documentation sites whose name isn't the package's.
FEEDS = {
    "react.dev": ("npm", "react"), "nextjs.org": ("npm", "next"), "vuejs.org": ("npm", "vue"), "svelte.dev": ("npm", "svelte"), "tailwindcss.com": ("npm", "tailwindcss"),
    "nodejs.org": ("github", "nodejs/node"), "fastapi.tiangolo.com": ("pypi", "fastapi"), "docs.djangoproject.com": ("pypi", "django"), "flask.palletsprojects.com": ("pypi", "flask"),
    "numpy.org": ("pypi", "numpy"), "pytorch.org": ("pypi", "torch"), "docs.pydantic.dev": ("pypi", "pydantic"), "kit.svelte.dev": ("npm", "@sveltejs/kit"), "vitejs.dev": ("npm", "vite"),
    "expressjs.com": ("npm", "express"),
}


def demand_once(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["seq"])


def frequency(events: DataFrame) -> DataFrame:
    """(docset, n): how often each set of documents is asked for."""
    return demand_once(events).groupBy(doc_set("url").alias("docset")).agg(F.count("*").alias("n"))


def sample_urls(events: DataFrame) -> DataFrame:
    """(docset, url): the address asked for last."""
    return demand_once(events).filter("url is not null").groupBy(doc_set("url").alias("docset")).agg(F.max_by("url", F.struct("at_ms", "seq")).alias("url"))


def feed_of(url: Column | str) -> Column:
    """struct<type, id> of the release feed of an address: a known site's, else what addresses of package hosts name; null for others."""

    def feed(a: Address) -> Column:
        name = F.regexp_replace(a.host, r"^www\.", "")
        known = F.create_map(*(x for k, v in FEEDS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("type"), F.lit(v[1]).alias("id")))))[name]
        parts = F.filter(F.split(a.path, "/"), lambda p: p != "")
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        repository = F.when(a.host.endswith("github.com") & second.isNotNull(), F.concat_ws("/", first, second))
        package = F.when(a.host.endswith("npmjs.com"), F.when(first == "package", F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")).otherwise(first))
        package = F.when(package != "", package)
        project = F.when(a.host.endswith("pypi.org") & (first == "project"), second)
        guess = F.coalesce(*(F.when(x.isNotNull(), F.struct(F.lit(kind).alias("type"), x.alias("id"))) for kind, x in (("github", repository), ("npm", package), ("pypi", project))))
        return F.when(a.valid, F.coalesce(known, guess))

    return with_address(url, feed)


def first_after(starts: DataFrame, events: DataFrame, window_ms: int, *keys: str) -> DataFrame:
    """(keys, start_at, first_at): the first event in (start, start + window] of each start; null where none follows.

    A forward as-of join without a join of rows. Time is cut into buckets as long as the window; what follows a start lies in its
    own bucket or is the next bucket's first event. Within (keys, bucket) starts and events are looked at once, the latest first,
    with a running minimum, so a hot key is spread over its buckets and no pairs are made. A null key is followed by nothing.
    """

    def bucket(at: Column) -> Column:
        return F.floor(at / window_ms)

    s = starts.select(*keys, F.col("start_at").alias("_t")).distinct().select(*keys, "_t", F.lit(None).cast("long").alias("_e"), F.lit(0).alias("_kind"))
    e = events.select(*keys, F.col("at_ms").alias("_t")).dropna().select(*keys, "_t", F.col("_t").alias("_e"), F.lit(1).alias("_kind"))
    rows = s.unionByName(e).withColumn("_b", bucket(F.col("_t")))
    by = Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.min("_e").over(by)).filter("_kind = 0")
    following = e.groupBy(*keys, (bucket(F.col("_t")) - 1).alias("_b")).agg(F.min("_t").alias("_next"))
    found = F.coalesce("_own", "_next")
    return own.join(following, [*keys, "_b"], "left").select(*keys, F.col("_t").alias("start_at"), F.when(found <= F.col("_t") + window_ms, found).alias("first_at"))


def hot_sets(asked: DataFrame, fallback: DataFrame, n: int = 100) -> DataFrame:
    """(docset, n, source): the n sets asked for most; where nothing was asked for, the domains that saved most. n is the report's size.

    `asked` has (docset, n), `fallback` (domain, saved).
    """
    top = top_members(asked, "docset", "n", n).withColumn("source", F.lit("demand"))
    spare = top_members(fallback.select(F.col("domain").alias("docset"), F.col("saved").alias("n")), "docset", "n", n).withColumn("source", F.lit("domains"))
    both = top.unionByName(spare).withColumn("_asked", F.max(F.col("source") == "demand").over(Window.partitionBy(F.lit(1))))  # 2 n rows at most
    return both.filter((F.col("source") == "demand") | ~F.col("_asked")).drop("_asked")


def coverage(found: DataFrame, changed: DataFrame, *keys: str) -> DataFrame:
    """One row: starts, followed by demand and by a change, the shares of both, keys, and keys with any start that demand follows.

    `found` and `changed` are rows of first_after over the same starts.
    """
    by_key = found.groupBy(*keys).agg(F.count("*").alias("starts"), F.count("first_at").alias("followed"))
    sums = by_key.agg(F.coalesce(F.sum("starts"), F.lit(0)).alias("starts"), F.coalesce(F.sum("followed"), F.lit(0)).alias("followed"), F.count("*").alias("keys"), F.count_if(F.col("followed") > 0).alias("keys_followed"))
    one = sums.unionByName(changed.agg(F.count("first_at").alias("changed")), allowMissingColumns=True)
    sums = one.agg(*(F.max(c).alias(c) for c in ("starts", "followed", "keys", "keys_followed", "changed")))
    share = F.coalesce(F.try_divide("followed", "starts"), F.lit(0.0))
    return sums.withColumn("precision", share).withColumn("change_share", F.coalesce(F.try_divide("changed", "starts"), F.lit(0.0)))


def recent_starts(starts: DataFrame, now: int, days: int = 120) -> DataFrame:
    """Starts that aren't older than the days that are looked at."""
    return starts.filter(F.col("start_at") >= F.lit(now) - F.lit(days * 24 * HOUR_MS))


def ranked_percentiles(values: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """(keys, p<percent> ...): the value at place min(n - 1, floor(percent * n / 100)) of each key's sorted values; nulls don't count.

    Values are counted, ranged by key and value and counted up within ranges; a range's counts before it come from the sums of
    ranges, of which there are as many as tasks. So a key with a third of all values is spread over tasks, and none is gathered.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranged = Scratch(values.sparkSession, "percentiles").keep(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "counts")
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_part") == F.col("_p")]
    within = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    upto = ranged.withColumn("_within", within).join(parts, same).withColumn("_upto", F.col("_within") + F.col("_before"))

    def at(percent: int) -> Column:
        return F.min(F.when(F.col("_upto") > F.least(F.col("_total") - 1, F.floor(F.col("_total") * percent / 100)), F.col(value))).alias(f"p{percent}")

    return upto.groupBy(*keys).agg(*(at(p) for p in percents))


def lead_times(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, starts, followed, share, p50_ms, p90_ms) of the rows of first_after."""
    lead = found.withColumn("lead", F.col("first_at") - F.col("start_at"))
    if not keys:
        return lead_times(found.withColumn("_all", F.lit(1)), "_all").drop("_all")
    sums = lead.groupBy(*keys).agg(F.count("*").alias("starts"), F.count("lead").alias("followed"))
    tops = ranked_percentiles(lead, list(keys), "lead", [50, 90]).withColumnsRenamed({"p50": "p50_ms", "p90": "p90_ms"})
    return sums.join(tops, list(keys), "left").withColumn("share", F.coalesce(F.try_divide("followed", "starts"), F.lit(0.0)))
