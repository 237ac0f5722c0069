"""Windows that open at the first event and count until they close: ordered folds in parallel.

A pause as long as the window always opens a new one, so a key's events fall into independent stretches between such pauses.
Stretches, not keys, are the unit of work: a key that holds a third of all events is spread over its stretches. Each
task streams its sorted rows with a constant state and never gathers a stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def _fold(window_ms: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        count, closes = 0, 0
        for batch in batches:
            counts, allowed = [], []
            for client, stretch, at in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if (client, stretch) != key or at >= closes:
                    key, count, closes = (client, stretch), 0, at + window_ms
                count += 1
                counts.append(count)
                allowed.append(count <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64()), pa.array(allowed, pa.bool_())], ["client", "at_ms", "seq", "n", "allowed"])

    return run


def _stretches(rows: DataFrame, window_ms: int) -> DataFrame:
    """Adds `stretch`, the time of the event that opened it.

    Time is cut into buckets as long as the window, so only the bucket before can hold an event less than a window back. All
    row-level work is by client and bucket; by client alone only one row a bucket is looked at.
    """
    before = rows.groupBy("client", (F.col("bucket") + 1).alias("bucket")).agg(F.max("at_ms").alias("before"))
    by = Window.partitionBy("client", "bucket").orderBy("at_ms", "seq")
    gap = F.col("at_ms") - F.coalesce(F.lag("at_ms").over(by), F.col("before"))
    opened = rows.join(before, ["client", "bucket"], "left").withColumn("gap", gap).withColumn("opens", F.when(F.col("gap") < window_ms, F.lit(None)).otherwise(F.col("at_ms")))
    last = opened.groupBy("client", "bucket").agg(F.max("opens").alias("opens"))
    earlier = Window.partitionBy("client").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.max("opens").over(earlier)).drop("opens")
    within = F.max("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return opened.join(carried, ["client", "bucket"]).withColumn("stretch", F.coalesce(within, "carried"))


def anchored_counts(requests: DataFrame, window_ms: int, limit: int) -> DataFrame:
    """(client, at_ms, seq, n, allowed): the place of each request in its window, and whether it is within the limit.

    A window opens with the first request after the last one closed. Refused requests count too. Ties in time go by seq.
    Requests without a time are left out; those without a client are one client.
    """
    rows = requests.filter("at_ms is not null").select(F.coalesce(F.col("client").cast("string"), F.lit("anon")).alias("client"), "at_ms", "seq").withColumn("bucket", F.floor(F.col("at_ms") / window_ms))
    spread = _stretches(rows, window_ms).select("client", "stretch", "at_ms", "seq").repartition("client", "stretch").sortWithinPartitions("client", "stretch", "at_ms", "seq")
    return spread.mapInArrow(_fold(window_ms, limit), "client string, at_ms long, seq long, n long, allowed boolean")
