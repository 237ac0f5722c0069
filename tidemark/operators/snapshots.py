"""What changed between full snapshots of a table.

Each snapshot's rows are reduced to the row that holds for each key, with a partial maximum before the shuffle, so however
often a key was delivered only one row a task moves. The reduced snapshots are range-partitioned and sorted by key
together, and each range is streamed once: the merge looks at neighbouring rows of a key, one for each snapshot it is in,
compares their digests and emits typed changes. Memory is one batch and the last row of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


CHANGES = "snap_no int, url_hash string, heading string, change string"


def section_key(heading: Column) -> Column:
    """Trimmed, in lower case; `(intro)` for a null heading."""
    return F.coalesce(F.lower(F.regexp_replace(heading, r"(?U)^\s+|\s+$", "")), F.lit("(intro)"))


def body_form(body: Column) -> Column:
    """Without trailing blanks, tabs and CRs of each line and without line ends at the end; a null body is an empty one."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?md)[ \t\r]+$", ""), r"\n+\z", "")


def held_rows(rows: DataFrame) -> DataFrame:
    """(snap_no, url_hash, heading, digest): of several rows of a snapshot and key the one loaded last holds.

    Of rows loaded at the same time the one with the greatest digest holds; a null loaded_at is the earliest. Rows without
    snap_no or url_hash belong to no snapshot or page and are left out.
    """
    keyed = rows.filter("snap_no is not null and url_hash is not null").select(
        "snap_no", "url_hash", section_key(F.col("heading")).alias("heading"), F.struct("loaded_at", F.sha2(body_form(F.col("body")), 256).alias("digest")).alias("row")
    )
    return keyed.groupBy("url_hash", "heading", "snap_no").agg(F.max("row").alias("row")).select("snap_no", "url_hash", "heading", F.col("row.digest").alias("digest"))


def _merge(numbers: list[int]):
    """Streams rows sorted by (url_hash, heading, snap_no) and emits the changes of each key."""
    place = {n: i for i, n in enumerate(numbers)}
    names = ["snap_no", "url_hash", "heading", "change"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # the last key may go on in the next batch
            same = pc.and_(pc.equal(rows.column("url_hash"), rows.column("url_hash")[-1]), pc.equal(rows.column("heading"), rows.column("heading")[-1]))
            cut = rows.num_rows - int(pc.sum(same).as_py())
            held = rows.slice(cut)
            if cut:
                yield from changes(rows.slice(0, cut))
        if held is not None:
            yield from changes(held)

    def changes(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        key, head, digest = rows.column("url_hash"), rows.column("heading"), rows.column("digest")
        at = np.array([place[x] for x in rows.column("snap_no").to_pylist()], np.int64)
        with_next = np.zeros(n, bool)
        equal = np.zeros(n, bool)
        if n > 1:
            with_next[:-1] = pc.and_(pc.equal(key[1:], key[:-1]), pc.equal(head[1:], head[:-1])).to_numpy(zero_copy_only=False)
            equal[:-1] = pc.equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)
        follows = with_next.copy()
        follows[:-1] &= at[1:] == at[:-1] + 1
        after = np.concatenate([[False], follows[:-1]])
        last = len(numbers) - 1
        for kind, here, number in (
            ("changed", np.nonzero(follows & ~equal)[0] + 1, at),
            ("added", np.nonzero(~after & (at > 0))[0], at),
            ("removed", np.nonzero(~follows & (at < last))[0], at + 1),
        ):
            if len(here):
                pick = pa.array(here)
                yield pa.RecordBatch.from_arrays([pa.array([numbers[i] for i in number[here]], pa.int32()), key.take(pick), head.take(pick), pa.array([kind] * len(here))], names)

    return run


def _ranged(reduced: DataFrame) -> DataFrame:
    """Reduced rows in ranges of their keys, sorted."""
    return reduced.select("url_hash", "heading", "snap_no", "digest").repartitionByRange("url_hash", "heading").sortWithinPartitions("url_hash", "heading", "snap_no")


def keep_snapshot(rows: DataFrame, path: str) -> None:
    """Writes one delivery's reduced rows in sorted ranges of keys, so that the next delivery needs no older one's texts."""
    _ranged(held_rows(rows)).write.mode("overwrite").parquet(path)


def next_changes(kept: DataFrame, delivery: DataFrame) -> DataFrame:
    """What snapshot_changes gives for one more delivery, from the kept snapshot before it, of which only keys and digests are read.

    `kept` is what keep_snapshot wrote; `delivery` has rows of one later snap_no, more than one or an earlier one is an error. A
    delivery without rows has no number, so nothing can be told of it.
    """
    number, least = delivery.agg(F.max("snap_no"), F.min("snap_no")).first()
    before = kept.agg(F.max("snap_no")).first()[0]
    if number is not None and (least != number or (before is not None and number <= before)):
        raise ValueError("a delivery has one snapshot, later than the kept one")
    if number is None:
        return delivery.sparkSession.createDataFrame([], CHANGES)
    numbers = [n for n in (before, number) if n is not None]
    return _ranged(kept.unionByName(held_rows(delivery))).mapInArrow(_merge(numbers), CHANGES)


def snapshot_changes(rows: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """(snap_no, url_hash, heading, change): for each snapshot after the first, what was added, removed or changed since the one before.

    `numbers` are the snapshots in order; if not given they are the distinct snap_no, whose number is that of deliveries.
    A snapshot in `numbers` without rows removes everything. No rows give no changes.
    """
    if numbers is None:
        numbers = sorted(r[0] for r in rows.select("snap_no").distinct().collect() if r[0] is not None)
    return _ranged(held_rows(rows)).mapInArrow(_merge(numbers), CHANGES)
