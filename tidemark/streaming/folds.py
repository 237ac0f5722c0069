"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

COUNTED = "client string, at_ms long, seq long, n long, allowed boolean"


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that custom state needs, for streams started within; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class AnchoredWindow(StatefulProcessor):
    """State of a client: requests in the open window and when it closes."""

    def __init__(self, window_ms: int, limit: int) -> None:
        self.window_ms, self.limit = window_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", StructType([StructField("n", LongType()), StructField("closes", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, closes = self.state.get() if self.state.exists() else (0, 0)
        for batch in rows:
            batch = batch.sort_values(["at_ms", "seq"])
            counts = []
            for at in batch["at_ms"]:
                if at >= closes:
                    n, closes = 0, int(at) + self.window_ms
                n += 1
                counts.append(n)
            yield pd.DataFrame({"client": key[0], "at_ms": batch["at_ms"], "seq": batch["seq"], "n": counts, "allowed": [c <= self.limit for c in counts]})
        self.state.update((n, closes))

    def close(self) -> None:
        pass


def anchored_counts(requests: DataFrame, window_ms: int, limit: int) -> DataFrame:
    """Streaming form of the anchored windows; needs the RocksDB state store. Requests are to come in order within a client."""
    return requests.groupBy("client").transformWithStateInPandas(AnchoredWindow(window_ms, limit), COUNTED, "Append", "None")


def first_writers(rows: DataFrame, key: str, at: str, hold: str) -> DataFrame:
    """The first row of each key; a key is free again once the watermark has passed `hold` after it."""
    return rows.withWatermark(at, hold).dropDuplicatesWithinWatermark([key])


def running_totals(activity: DataFrame) -> DataFrame:
    """Running counters for output modes complete and update: tokens saved, hits and misses by domain."""
    saved = F.greatest(F.lit(0).cast("long"), F.coalesce("saved", F.lit(0)))
    return activity.groupBy("domain").agg(F.sum(saved).alias("saved"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def timed_counts(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by tumbling window and type with late rows dropped after `late`; timestamps without zone are taken as UTC."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
