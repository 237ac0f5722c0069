"""The row before, without one task for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.sources.scratch import Scratch


def _shifted():
    """Adds the value of the row before it in the task, whether there is one, and marks the task's first and last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        last_key = last_value = None
        first = True

        def marked(batch: pa.RecordBatch, is_last: bool) -> pa.RecordBatch:
            nonlocal last_key, last_value, first
            n = batch.num_rows
            key, value = batch.column("_key"), batch.column("_value")
            keys = pa.concat_arrays([pa.array([last_key], key.type), key[:-1]])
            values = pa.concat_arrays([pa.array([last_value], value.type), value[:-1]])
            same = pc.fill_null(pc.equal(keys, key), False)
            starts = pa.array([first] + [False] * (n - 1))
            ends = pa.array([False] * (n - 1) + [is_last])
            last_key, last_value, first = key[-1].as_py(), value[-1].as_py(), False
            before = pc.if_else(same, values, pa.scalar(None, value.type))
            return pa.RecordBatch.from_arrays([*batch.columns, before, pa.array([part] * n, pa.int32()), starts, ends], [*batch.schema.names, "_before", "_part", "_first", "_last"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield marked(held, False)
                held = batch
        if held is not None:
            yield marked(held, True)

    return run


def with_previous(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the value of the row before within the key, by `order`; null for a key's first row.

    Rows are range-partitioned by key and order, so a key that holds a third of all rows is spread over tasks; each
    streams its rows with one value of state. Only a task's first row can have its predecessor elsewhere: it gets it from the
    last rows of the tasks, of which there are as many as tasks. Rows with a null key have no predecessor.
    """
    ranged = rows.withColumn("_key", F.col(key).cast("string")).withColumn("_value", F.col(value)).repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kind = rows.schema[value].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields) + f", _before {kind}, _part int, _first boolean, _last boolean"
    kept = Scratch(rows.sparkSession, "previous").keep(ranged.mapInArrow(_shifted(), schema), "rows")
    edges = kept.filter("_last").select("_part", F.col("_key").alias("_edge_key"), F.col("_value").alias("_edge_value"))
    # of the tasks that have rows, the one before
    by = Window.orderBy("_part")
    before = edges.select("_part", F.lag("_edge_key").over(by).alias("_edge_key"), F.lag("_edge_value").over(by).alias("_edge_value"))
    joined = kept.join(before, "_part", "left")
    crossing = F.col("_first") & (F.col("_edge_key") == F.col("_key"))
    return joined.select(*rows.columns, F.when(crossing, F.col("_edge_value")).otherwise(F.col("_before")).alias(name))
