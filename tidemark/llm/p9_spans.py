"""Long exact spans shared between records.

Two operators. `repeated_paragraphs` is the plain form of unit hashing: paragraphs are normalised, their digests grouped
globally, the earliest ranked occurrence is kept and the rest are removed, with offsets into the original text.

`shared_spans` finds verbatim stretches wherever they begin or end, which whole lines or paragraphs can't. Its units are
cut by content: of each window of `span` characters the run of UNIT characters with the least hash is a unit, so equal
windows hold equal units wherever they stand. Digests are grouped globally in three rounds, each only over what the
round before has left: units; the stretches that parts of a shared unit's windows cover; single windows. The parts whose
stretch is the same wherever the unit stands are thereby settled, and those whose windows have a core in common that stands in no other document share nothing. Groups are reduced to their least and greatest document with partial counts a task, so a unit that stands in
a third of all documents makes no large group, and no pairs of documents are made.

Stretches and windows are held to be equal if they agree in 96 bits of two hashes: among 10^14 windows less than one pair
agrees by chance. Units only choose where to look, so 64 bits do for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from tidemark.sources.scratch import Scratch

SPAN = 320
UNIT = 96
#: Characters worked on together; a longer text is worked on in pieces that overlap.
BLOCK = 1 << 20
#: Windows of a unit that are settled together.
PART = 32
_BASE = 0x9E3779B97F4A7C15
_SECOND_BASE = 0xC2B2AE3D27D4EB4F
_TOP = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some texts, or a piece of one, after one another, with hashes of all their substrings.

    The hash of a substring is a polynomial of its mixed characters modulo 2**64, got from prefix sums; `check` is half of
    a second one, of other characters and base, so that what is held to be equal agrees in 96 bits.
    """

    _powers: tuple[np.ndarray, ...] = (np.ones(1, np.uint64),) * 4

    def __init__(self, docs: list[int], pieces: list[str], offsets: list[int]) -> None:
        self.docs, self.offsets = np.array(docs, np.int64), np.array(offsets, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(lengths) - lengths
        self.text = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        self.size = n = len(self.text)
        self.owner = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        self.ends = (self.starts + lengths)[self.owner] if n else np.empty(0, np.int64)
        if len(Block._powers[0]) <= n:
            top = max(n + 1, BLOCK + 1)
            powers = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64), _SECOND_BASE, pow(_SECOND_BASE, -1, 1 << 64)):
                power = np.full(top, base, np.uint64)
                power[0] = 1
                powers.append(np.multiply.accumulate(power))
            Block._powers = tuple(powers)
        self.sums, self.second = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        letters = _mixed(self.text.astype(np.uint64) + np.uint64(1))
        np.cumsum(letters * Block._powers[0][:n], out=self.sums[1:])
        np.cumsum(_mixed(letters + np.uint64(1)) * Block._powers[2][:n], out=self.second[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each substring; its length is part of the hash."""
        return _mixed((self.sums[ends] - self.sums[starts]) * Block._powers[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def checks(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The upper half of each substring's second hash."""
        return (_mixed((self.second[ends] - self.second[starts]) * Block._powers[3][starts]) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n characters at each place, and whether the run lies within one text."""
        at = np.arange(max(0, self.size - n + 1))
        return self.hashes(at, at + n), at + n <= self.ends[: len(at)]

    def units(self, span: int, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, digests, first windows, last windows) of the units.

        A window's unit is its run with the least hash, of equal ones the leftmost. The windows of a unit follow one another.
        """
        h, _ = self.windows(unit)
        width = span - unit + 1
        if len(h) < width:
            return (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        low = np.uint64(BLOCK - 1)
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), width)
        window = np.nonzero(np.arange(len(least)) + span <= self.ends[: len(least)])[0]
        chosen = (least[window] & low).astype(np.int64)
        opens = np.ones(len(window), bool)
        opens[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.nonzero(opens)[0]
        last = np.concatenate([first[1:], [len(window)]]).astype(np.int64) - 1
        return chosen[first], h[chosen[first]], window[first], window[last]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place in its whole text)."""
        o = self.owner[at]
        return self.docs[o], at - self.starts[o] + self.offsets[o]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    grid = np.concatenate([values, np.full(-n % width, _TOP)]).reshape(-1, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _blocks(rows: Iterator[tuple[int, str | None, object]], span: int) -> Iterator[tuple[Block, dict[int, object]]]:
    """Blocks of about BLOCK characters, with the third field of each document. Every window of span characters lies in a block."""
    docs, pieces, offsets, extra, size = [], [], [], {}, 0
    for doc, text, more in rows:
        if text is None or len(text) < span:
            continue
        for at in range(0, max(1, len(text) - span + 1), BLOCK - span + 1):
            piece = text[at : at + BLOCK] if len(text) > BLOCK else text
            if pieces and size + len(piece) > BLOCK:
                yield Block(docs, pieces, offsets), extra
                docs, pieces, offsets, extra, size = [], [], [], {}, 0
            docs.append(doc)
            pieces.append(piece)
            offsets.append(at)
            extra[doc] = more
            size += len(piece)
    if pieces:
        yield Block(docs, pieces, offsets), extra


def _rows(batch: pa.RecordBatch, arrays: int = 0) -> Iterator[tuple]:
    columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
    lists = [batch.column(2 + k) for k in range(arrays)]
    for i, (doc, text) in enumerate(zip(*columns)):
        yield doc, text, tuple(np.asarray(x[i].values) if x[i].is_valid else np.empty(0, np.int64) for x in lists)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def _unit_rows(span: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, _ in _blocks(_rows(batch), span):
                at, digest, _, _ = block.units(span, unit)
                if len(at):
                    pairs, times = np.unique(np.stack([block.place(at)[0], digest.view(np.int64)]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([_long(pairs[0]), _long(pairs[1]), _long(times)], ["doc", "digest", "times"])

    return run


def _shared_units(block: Block, extra: dict, span: int, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, occurrences in all documents) of the units whose digest is in their document's list."""
    at, digest, first, last = block.units(span, unit)
    times = np.zeros(len(at), np.int64)
    cuts = np.searchsorted(block.owner[at], np.arange(len(block.docs) + 1))
    for doc, start, stop in zip(block.docs.tolist(), cuts, cuts[1:]):
        listed, occurrences = extra[doc][:2]
        if start == stop or not len(listed):
            continue
        by = np.argsort(listed)
        found = by[np.minimum(np.searchsorted(listed[by], digest[start:stop].view(np.int64)), len(by) - 1)]
        times[start:stop] = np.where(listed[found] == digest[start:stop].view(np.int64), occurrences[found], 0)
    shared = times > 0
    return at[shared], first[shared], last[shared], times[shared]


def _parts(at: np.ndarray, first: np.ndarray, last: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """(row, first, last, low, high): the windows of each unit in parts of PART windows, cut at fixed distances from the unit; low and high are the first and last window of a part whose unit has all its windows."""
    zero = at - reach
    low, high = (first - zero) // PART, (last - zero) // PART
    sizes = high - low + 1
    row = np.repeat(np.arange(len(at)), sizes)
    part = low[row] + np.arange(sizes.sum()) - (np.cumsum(sizes) - sizes)[row]
    begin = zero[row] + part * PART
    return row, np.maximum(first[row], begin), np.minimum(last[row], begin + PART - 1), begin, begin + PART - 1


def _stretch_rows(span: int, unit: int):
    """The stretches that parts of a shared unit's windows cover, what all of a part's windows have in common, and how often the unit occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, extra in _blocks(_rows(batch, 2), span):
                at, first, last, times = _shared_units(block, extra, span, unit)
                row, first, last, low, high = _parts(at, first, last, span - unit)
                at, times = at[row], times[row]
                doc, begin = block.place(first)
                core = _mixed(block.hashes(high, low + span) + (at - low).astype(np.uint64))
                digest = _mixed(block.hashes(first, last + span) + (at - first).astype(np.uint64))
                check = pa.array(block.checks(first, last + span))
                yield pa.RecordBatch.from_arrays([_long(doc), _long(digest), check, _long(core), _long(begin), _long(begin + (last - first)), _long(times)], ["doc", "digest", "check", "core", "first", "last", "times"])

    return run


def _window_rows(span: int, unit: int):
    """Windows of the parts that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, extra in _blocks(_rows(batch, 3), span):
                at, first, last, _ = _shared_units(block, extra, span, unit)
                _, first, last, _, _ = _parts(at, first, last, span - unit)
                _, begin = block.place(first)
                open_ = np.zeros(len(first), bool)
                cuts = np.searchsorted(block.owner[first], np.arange(len(block.docs) + 1))
                for d, start, stop in zip(block.docs.tolist(), cuts, cuts[1:]):
                    open_[start:stop] = np.isin(begin[start:stop], extra[d][2])
                first, sizes = first[open_], (last - first + 1)[open_]
                place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                doc, begin = block.place(place)
                check = pa.array(block.checks(place, place + span))
                yield pa.RecordBatch.from_arrays([_long(doc), _long(block.hashes(place, place + span)), check, _long(begin)], ["doc", "digest", "check", "first"])

    return run


def _in_several(rows: DataFrame, *counts, by: tuple[str, ...] = ("digest", "check")) -> DataFrame:
    """Digests that stand in two documents or more, with further aggregates."""
    return rows.groupBy(*by).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), *counts).filter("a < b").drop("a", "b")


def shared_spans(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", span: int = SPAN, unit: int = UNIT) -> DataFrame:
    """(doc_col, span_start, span_end): maximal runs of the positions that lie in a window of `span` characters which also
    stands verbatim in another document.

    Positions are 0-based characters, the end exclusive. Rows with one doc_col count as one document. Null texts and texts
    shorter than `span` share nothing.
    """
    texts = documents.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter((F.length("text") >= span) & F.col("doc").isNotNull())
    scratch = Scratch(documents.sparkSession, "p9")
    units = scratch.keep(texts.mapInArrow(_unit_rows(span, unit), "doc long, digest long, times long"), "units")
    listed = units.select("doc", "digest").join(_in_several(units, F.sum("times").alias("n"), by=("digest",)), "digest").groupBy("doc").agg(F.collect_list(F.struct("digest", "n")).alias("u"))
    near = scratch.keep(texts.join(listed, "doc").select("doc", "text", F.col("u.digest").alias("units"), F.col("u.n").alias("times")), "near")
    scratch.drop("units")
    stretches = scratch.keep(near.mapInArrow(_stretch_rows(span, unit), "doc long, digest long, check int, core long, first long, last long, times long"), "stretches")
    common = scratch.keep(stretches.join(_in_several(stretches, F.count("*").alias("n")), ["digest", "check"]).select("doc", "first", "last", (F.col("n") == F.col("times")).alias("settled")), "common")
    settled = common.filter("settled").select("doc", "first")
    several = _in_several(stretches.select("doc", F.col("core").alias("digest")), by=("digest",)).withColumnRenamed("digest", "core")
    open_ = stretches.select("doc", "core", "first").join(several, "core", "left_semi").join(settled, ["doc", "first"], "left_anti").groupBy("doc").agg(F.collect_set("first").alias("begins"))
    windows = scratch.keep(near.join(open_, "doc").select("doc", "text", "units", "times", "begins").mapInArrow(_window_rows(span, unit), "doc long, digest long, check int, first long"), "windows")
    scratch.drop("near", "stretches")
    single = windows.join(_in_several(windows), ["digest", "check"], "left_semi").select("doc", "first", F.col("first").alias("last"))
    return _joined_runs(common.select("doc", "first", "last").unionByName(single), span).select(F.col("doc").alias(doc_col), "span_start", "span_end")


def _joined_runs(ranges: DataFrame, span: int) -> DataFrame:
    """Unions of the windows that begin in [first, last]; ranges that touch become one."""
    by = Window.partitionBy("doc").orderBy("first", "last")
    before = F.max(F.col("last") + span).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", F.when(F.col("first") <= before, 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc", "run").agg(F.min("first").alias("span_start"), F.max(F.col("last") + span).alias("span_end"))


def shared_portion(documents: DataFrame, spans: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its characters, those shared with other documents, and their share; a null text has 0 characters and share 0."""
    sums = spans.groupBy(doc_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("_shared"))
    sizes = documents.groupBy(doc_col).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("long").alias("n_chars"))
    joined = sizes.join(sums, doc_col, "left").select(doc_col, "n_chars", F.coalesce("_shared", F.lit(0)).alias("shared_chars"))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))


def paragraph_units(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", least: int = 40) -> DataFrame:
    """(doc, start, end, digest) of each paragraph of `least` characters or more in normal form: lower case, white space as one blank."""
    cut = F.expr(
        f"transform(split({text_col}, '\\n\\n'), (p, i) -> struct(p as p, cast(length(p) as bigint) as n))"
    )
    parts = documents.select(F.col(doc_col).alias("doc"), F.posexplode(cut).alias("pos", "part")).select("doc", "pos", "part.p", "part.n")
    by = Window.partitionBy("doc").orderBy("pos")
    placed = parts.dropDuplicates(["doc", "pos"]).withColumn("start", F.coalesce(F.sum(F.col("n") + 2).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    form = F.trim(F.regexp_replace(F.lower("p"), r"\s+", " "))
    return placed.withColumn("form", form).filter(F.length("form") >= least).select("doc", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("end"), F.sha2("form", 256).alias("digest"))


def repeated_paragraphs(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", least: int = 40) -> DataFrame:
    """(doc_id, span_start, span_end, kept_doc, kept_start): the paragraphs to remove, with the earliest occurrence, which stays.

    Occurrences are ranked by document and place. Groups are reduced to their first occurrence by a partial minimum.
    """
    scratch = Scratch(documents.sparkSession, "p9u")
    units = scratch.keep(paragraph_units(documents, doc_col, text_col, least), "units")
    first = units.groupBy("digest").agg(F.min(F.struct("doc", "start")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    again = units.join(first, "digest").filter((F.col("doc") != F.col("kept.doc")) | (F.col("start") != F.col("kept.start")))
    return again.select(F.col("doc").alias(doc_col), F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("kept.doc").alias("kept_doc"), F.col("kept.start").alias("kept_start"))
