"""Counters and leaderboards of the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.store import newest, top_members


def log_once(activity: DataFrame) -> DataFrame:
    """Redelivered rows count once, by arrival number."""
    return activity.dropDuplicates(["seq"])


def saved_tokens(saved: Column | str) -> Column:
    c = F.col(saved) if isinstance(saved, str) else saved
    return F.greatest(F.lit(0).cast("long"), F.coalesce(c, F.lit(0)))


def site_name(domain: Column | str) -> Column:
    """A host in lower case without blanks, closing dots and a leading `www.`; `unknown` where there is none."""
    c = F.col(domain) if isinstance(domain, str) else domain
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.+$", ""), r"^www\.", "")
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(name)


def totals(activity: DataFrame) -> DataFrame:
    """One row: tokens_saved, hits, misses, hit_rate and mean_saved; a null hit is neither. An empty log gives zeros."""
    once = log_once(activity)
    sums = once.agg(F.coalesce(F.sum(saved_tokens("saved")), F.lit(0)).alias("tokens_saved"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    fetches = F.col("hits") + F.col("misses")
    rate = F.coalesce(F.try_divide("hits", fetches), F.lit(0.0))
    mean = F.coalesce(F.floor(F.try_divide("tokens_saved", fetches) + 0.5), F.lit(0)).cast("long")
    return sums.withColumn("hit_rate", rate).withColumn("mean_saved", mean)


def saved_by_site(activity: DataFrame) -> DataFrame:
    """(domain, saved)."""
    return log_once(activity).groupBy(site_name("domain").alias("domain")).agg(F.sum(saved_tokens("saved")).alias("saved"))


def leaders(activity: DataFrame, n: int = 8) -> DataFrame:
    return top_members(saved_by_site(activity), "domain", "saved", n)


def recent(activity: DataFrame, n: int = 30) -> DataFrame:
    """The newest n events by arrival."""
    return newest(log_once(activity), n, "seq")


def short_count(n: Column) -> Column:
    """`950`, or `1.2K` from a thousand on."""
    tenths = F.floor(n / 100 + 0.5)
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit("K")))


def stats_json(activity: DataFrame, n: int = 8) -> DataFrame:
    """One row, `stats`: totals and leaders as JSON."""
    top = leaders(activity, n).agg(F.sort_array(F.collect_list(F.struct((-F.col("saved")).alias("o"), "domain", "saved"))).alias("top"))
    rows = F.transform("top", lambda x: F.struct(x["domain"].alias("member"), x["saved"].alias("score")))
    one = totals(activity).select(F.to_json(F.struct("tokens_saved", "hits", "misses")).alias("_t"), F.lit(1).alias("_k"))
    return one.join(top.select(F.to_json(rows).alias("_top"), F.lit(1).alias("_k")), "_k").select(F.concat(F.expr("left(_t, length(_t) - 1)"), F.lit(',"top_domains":'), "_top", F.lit("}")).alias("stats"))
