"""Most frequent items among billions, by external sort and run-length counting.

Each task sorts its values and turns them into runs with counts; the runs are range-partitioned by value, so equal values
meet in one range as at most one run a task however frequent they are; sorted runs are merged with combined counts,
and each range keeps a bounded heap. Memory is bounded by the sorter, which spills, and the heaps.

A null value is no item but its event counts in the total. Rows with the same id are one event. Values are taken as they
stand. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.sources.scratch import Scratch


RUNS = "field string, value string, n long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length counts of the sorted pairs (field, value), or of sorted runs (field, value, n) with their counts combined; a run may go on over the end of a batch."""
    names = ["field", "value", "n"]
    last: tuple[str, str] | None = None
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        field, value = batch.column(0), batch.column(1)
        new = pc.or_(pc.not_equal(field[1:], field[:-1]), pc.not_equal(value[1:], value[:-1])) if batch.num_rows > 1 else pa.array([], pa.bool_())
        starts = pa.concat_arrays([pa.array([0], pa.int64()), pc.add(pc.indices_nonzero(new).cast(pa.int64()), 1)])
        if batch.num_columns > 2:
            lengths = np.add.reduceat(batch.column(2).to_numpy(), starts.to_numpy()).tolist()
        else:
            lengths = pc.subtract(pa.concat_arrays([starts[1:], pa.array([batch.num_rows], pa.int64())]), starts).to_pylist()
        fields, values = field.take(starts), value.take(starts)
        first = (fields[0].as_py(), values[0].as_py())
        if last is not None and first == last:
            lengths[0] += held
        elif last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([held], pa.int64())], names)
        last, held = (fields[-1].as_py(), values[-1].as_py()), lengths[-1]
        if len(lengths) > 1:
            yield pa.RecordBatch.from_arrays([fields[:-1], values[:-1], pa.array(lengths[:-1], pa.int64())], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.array([held], pa.int64())], names)


def _heaps(size: int):
    """The `size` greatest counts of each field in a range, ties by the smaller value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {}
        for batch in batches:
            for field in pc.unique(batch.column(0)).to_pylist():
                rows = batch.filter(pc.equal(batch.column(0), field))
                heap = heaps.get(field, [])
                if len(heap) == size:
                    rows = rows.filter(pc.greater_equal(rows.column(2), heap[0][0]))
                pairs = [*heap, *((n, _Late(v)) for v, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()))]
                heaps[field] = sorted(heapq.nlargest(size, pairs))
        for field, heap in heaps.items():
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(heap)), pa.array([v.value for _, v in heap], pa.string()), pa.array([n for n, _ in heap], pa.int64())], ["field", "value", "n"])

    return run


class _Late:
    """Orders values backwards, so that of equal counts the smaller value is the greater pair."""

    __slots__ = ("value",)

    def __init__(self, value: str) -> None:
        self.value = value

    def __lt__(self, other: _Late) -> bool:
        return self.value > other.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Late) and self.value == other.value


def events_once(events: DataFrame, fields: list[str], id_col: str = "seq") -> DataFrame:
    """Redelivered rows count once; of differing rows with one id, the greatest holds. Rows with a null id count as one."""
    return events.groupBy(id_col).agg(F.max(F.struct(*fields)).alias("v")).select(id_col, "v.*")


#: Field under which every event is counted once, whatever its values.
EVENTS = ""


def sorted_runs(values: DataFrame) -> DataFrame:
    """(field, value, n): each task's values in runs, written."""
    return Scratch(values.sparkSession, "p6").keep(values.sortWithinPartitions("field", "value").mapInArrow(_runs, RUNS), "runs")


def merged_runs(runs: DataFrame) -> DataFrame:
    """(field, value, n): one row for each distinct pair, in ranges of (field, value)."""
    return runs.repartitionByRange("field", "value").sortWithinPartitions("field", "value").mapInArrow(_runs, RUNS)


def run_lengths(values: DataFrame) -> DataFrame:
    """(field, value, n): one row for each distinct pair, in ranges of (field, value)."""
    return merged_runs(sorted_runs(values))


def counted(events: DataFrame, fields: list[str], id_col: str) -> tuple[DataFrame, int]:
    """(field, value, n), one row for each distinct pair, in ranges of (field, value); and the number of events.

    The events are read and brought together once: their number comes from the runs too.
    """
    pairs = F.array(F.struct(F.lit(EVENTS).alias("field"), F.lit("").alias("value")), *(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    values = events_once(events, fields, id_col).select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null")
    runs = sorted_runs(values)
    total = runs.filter(F.col("field") == EVENTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return merged_runs(runs.filter(F.col("field") != EVENTS)), total


def heavy_hitters(events: DataFrame, shares: dict[str, float], id_col: str = "seq") -> DataFrame:
    """(field, value, n, total): the values that hold at least their field's share of the distinct events.

    A heap of 1 + 1/share values a range can't lose one: no more values than 1/share can hold that share. Counts are exact.
    """
    counts, total = counted(events, list(shares), id_col)
    least = {f: math.ceil(Fraction(str(s)) * total) for f, s in shares.items()}
    size = max(math.floor(1 / Fraction(str(s))) + 1 for s in shares.values())
    top = counts.mapInArrow(_heaps(size), RUNS)
    limit = F.create_map(*(x for f, n in least.items() for x in (F.lit(f), F.lit(n))))[F.col("field")]
    return top.filter(F.col("n") >= limit).withColumn("total", F.lit(total))


def top_k(events: DataFrame, field: str, k: int, id_col: str = "seq") -> DataFrame:
    """(value, n) of the k most frequent values, ties by value; k is the feature's limit."""
    counts, _ = counted(events, [field], id_col)
    return counts.mapInArrow(_heaps(k), RUNS).orderBy(F.desc("n"), "value").limit(k).select("value", "n")
