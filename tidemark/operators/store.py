"""A mutable key-value store as views of append-only logs.

Every view is an aggregation or window by key over an event log; TTLs are compared with an explicit `now` in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row that holds for each key: the greatest by `order`, nulls first. A partial maximum runs before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in (*order, *rest)))


def put_if_absent(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first writer of each key holds it."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in (*order, *rest)))


def live(rows: DataFrame, at: str, ttl_ms: int | Column, now: int) -> DataFrame:
    """Rows that haven't expired at `now`."""
    return rows.filter(F.col(at) + ttl_ms > F.lit(now))


def newest(rows: DataFrame, n: int, *order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The newest n rows of each key, or of all; n is the ring's size.

    Order by as many columns as make it total. With keys, Spark filters each task's rows by rank before the shuffle.
    """
    by = [F.desc(c) for c in order]
    if not keys:
        return rows.orderBy(*by).limit(n)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("_rank") <= n).drop("_rank")


def counters(rows: DataFrame, *keys: str, amount: str | None = None) -> DataFrame:
    """Sums of rounded amounts, or counts, by key."""
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.floor(F.col(amount) + 0.5)), F.lit(0)) if amount else F.count("*")).cast("long").alias("n"))


def read_counter(keys: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """The counter of each key; 0 where nothing was counted."""
    return keys.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def delete(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows whose key hasn't been deleted."""
    return rows.join(tombstones.select(key), key, "left_anti")


def top_members(scores: DataFrame, member: str, score: str, n: int) -> DataFrame:
    """The n members of greatest score, ties by member."""
    return scores.orderBy(F.desc(score), F.asc(member)).limit(n)
