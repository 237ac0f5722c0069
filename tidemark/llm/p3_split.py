"""Splitting oversized items at natural boundaries.

A dynamic programme over boundary positions minimises cut penalties and size imbalance, subject to the maximum length and
the overlap of consecutive pieces. Lengths are UTF-16 code units; a character is never cut.

Null and empty bodies, and those within the limit, aren't split. Rows that come twice give their pieces twice; take distinct
rows where that matters. A body without any boundary is cut between characters. No piece is ever over the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 2000
OVERLAP = 200
#: Weight of the squared relative deviation from equal sizes, in units of penalty.
IMBALANCE = 4.0
#: Penalty of each further piece.
PIECE = 1.0
#: Penalties of cuts after: a blank line, a line end, a sentence, a word, any other character. A cut in fenced code costs more.
PENALTIES = {"paragraph": 0.0, "line": 1.0, "sentence": 2.0, "word": 5.0, "character": 1000.0}
IN_CODE = 3.0
#: Where a stretch without natural boundaries is longer than a WIDE-th of what a piece can add, cuts between characters are
#: offered at every FINE-th of it; both go with the limit, so that whatever it is a way exists.
WIDE = 4
FINE = 36

_BOUNDARIES = [
    ("word", re.compile(r"\s+")),
    ("sentence", re.compile(r"[.!?…][\"')\]»”’*_]*\s+|[。！？]+[」』）]*")),
    ("line", re.compile(r"\n[ \t]*")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
]
_FENCE = re.compile(r"^[ \t>]*(?:```|~~~)[^\n]*\n?", re.M)


def boundaries(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions within the text where it may be cut, and their penalties."""
    cost = np.full(len(text) + 1, np.inf)
    for kind, pattern in _BOUNDARIES:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        cost[ends] = PENALTIES[kind]
    fences = [m.start() if i % 2 == 0 else m.end() for i, m in enumerate(_FENCE.finditer(text))]
    for begin, end in zip(fences[::2], [*fences[1::2], len(text)]):
        cost[begin + 1 : end] += IN_CODE
    cost[0] = cost[-1] = np.inf
    natural = np.concatenate([[0], np.nonzero(np.isfinite(cost))[0], [len(text)]])
    step = max(1, reach // FINE)
    for a, b in zip(natural[:-1], natural[1:]):
        if b - a > reach // WIDE:
            cost[a + step : b : step] = PENALTIES["character"]
    at = np.nonzero(np.isfinite(cost))[0]
    return at, cost[at]


class _Hull:
    """Least of lines (slope, height, name) at a place, for lines added by falling slope and places that rise; or both the other way."""

    def __init__(self, sign: int) -> None:
        self.sign = sign
        self.lines: list[tuple[float, float, int]] = []
        self.at = 0

    def add(self, slope: float, height: float, name: int) -> None:
        slope *= self.sign
        lines = self.lines
        while lines and lines[-1][0] == slope:
            if lines[-1][1] <= height:
                return
            lines.pop()
        while len(lines) > 1:
            (m, b, _), (n, c, _) = lines[-2:]
            if (height - b) * (m - n) <= (c - b) * (m - slope):  # the last one is nowhere least
                lines.pop()
            else:
                break
        lines.append((slope, height, name))
        self.at = min(self.at, len(lines) - 1)

    def least(self, x: float) -> int:
        """Name of the line that is least at x, -1 without lines."""
        x *= self.sign
        lines, k = self.lines, self.at
        if not lines:
            return -1
        value = lines[k][0] * x + lines[k][1]
        while k + 1 < len(lines):
            after = lines[k + 1][0] * x + lines[k + 1][1]
            if after > value:
                break
            k, value = k + 1, after
        self.at = k
        return lines[k][2]


def _cheapest(unit: list[int], penalty: list[float], limit: int, overlap: int, ideal: float) -> list[int]:
    """Of each boundary the one before it on the cheapest way, 0 for the start; linear in the number of boundaries.

    Unrolled, the cost of coming from i to j is a line in unit[j]. The boundaries from which j can be reached are a window
    that moves with j, and blocks of the window's width cut it in two: the own block up to j, to which lines are only added,
    and the end of the block before, to which lines are only added when j runs backwards.
    """
    reach, n = limit - overlap, len(unit)
    weight, shift = IMBALANCE / ideal**2, overlap - ideal
    best, before = [float("inf")] * n, [0] * n

    def line(i: int, zero: int) -> tuple[float, float, int]:
        y = unit[i] - zero - shift
        return -2 * weight * y, best[i] + weight * y * y, i

    block_of = [u // reach for u in unit]
    start = 1
    older: range = range(0)
    while start < n:
        stop = start
        while stop < n and block_of[stop] == block_of[start]:
            stop += 1
        zero = block_of[start] * reach  # places are counted from here, so that the squares stay small
        far = [-1] * (stop - start)
        if older and block_of[older[0]] + 1 == block_of[start]:
            hull, k = _Hull(-1), older[-1]
            for j in range(stop - 1, start - 1, -1):
                while k >= older[0] and unit[k] >= unit[j] - reach:
                    if best[k] < float("inf"):
                        hull.add(*line(k, zero))
                    k -= 1
                far[j - start] = hull.least(unit[j] - zero)
        near = _Hull(1)
        for j in range(start, stop):
            value, source = float("inf"), -1
            if overlap < unit[j] <= limit:  # as the first piece, which must be longer than the overlap it hands on
                value, source = IMBALANCE * (unit[j] / ideal - 1) ** 2, 0
            for i in (far[j - start], near.least(unit[j] - zero)):
                if i > 0:
                    cost = best[i] + IMBALANCE * ((unit[j] - unit[i] + overlap) / ideal - 1) ** 2
                    if cost < value:
                        value, source = cost, i
            if source < 0:
                continue
            best[j], before[j] = value + penalty[j] + PIECE, source
            near.add(*line(j, zero))
        older, start = range(start, stop), stop
    if best[-1] == float("inf"):
        raise AssertionError("no way within the limit")
    return before


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """(starts, ends) of the pieces in characters; each piece after the first starts up to `overlap` units before the end of the one before.

    No piece is over the limit. A limit that leaves no room for a character of two units beside the overlap is an error.
    """
    if overlap < 0 or limit - overlap < 2:
        raise ValueError("the limit must exceed the overlap by 2 units or more")
    units = np.zeros(len(text) + 1, np.int64)
    units[1:] = np.cumsum(1 + (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF))
    total = int(units[-1])
    if total <= limit:
        return [0], [len(text)]
    reach = limit - overlap
    at, penalty = boundaries(text, reach)
    at, penalty = np.concatenate([[0], at, [len(text)]]), np.concatenate([[0.0], penalty, [0.0]])
    pieces = -(-(total - overlap) // reach)
    ideal = (total + (pieces - 1) * overlap) / pieces
    before = _cheapest(units[at].tolist(), penalty.tolist(), limit, overlap, ideal)
    ends = [len(at) - 1]
    while before[ends[-1]]:
        ends.append(before[ends[-1]])
    ends = [int(at[k]) for k in reversed(ends)]
    starts = [0, *(int(np.searchsorted(units, units[e] - overlap)) for e in ends[:-1])]
    return starts, ends


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for page, pos, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
                starts, ends = cut_points(body, limit, overlap)
                last = 0
                for k, (a, b) in enumerate(zip(starts, ends)):
                    for column, value in zip(out, (page, pos, k, a, b, last - a, body[a:b])):
                        column.append(value)
                    last = b
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.string())], ["page_id", "pos", "piece", "start", "end", "overlap", "text"])

    return run


def utf16_units(text) -> F.Column:
    return F.length(F.encode(text, "UTF-16BE")) / 2


def split_sections(index: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, id_col: str = "page_id", sections_col: str = "sections") -> DataFrame:
    """(page_id, pos, piece, start, end, overlap, text) of the entries whose body has more than `limit` units, whatever their tokens say.

    start, end and overlap are characters of the body; overlap is how many of them repeat the end of the piece before.
    """
    entries = index.select(F.col(id_col).cast("long").alias("page_id"), F.posexplode(sections_col).alias("pos", "s")).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("s.body").alias("body"))
    # a character has at most two units, so most bodies needn't be encoded to be told small
    large = entries.filter((F.length("body") * 2 > limit) & (utf16_units(F.col("body")) > limit))
    return large.mapInArrow(_pieces(limit, overlap), "page_id long, pos long, piece long, start long, end long, overlap long, text string")


def rebuilt(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(page_id, pos, body, pieces, within): what the pieces of an entry give without their overlaps, and whether all are within the limit.

    The pieces of one entry come together, which are as large as its body. Rows that come twice count once.
    """
    own = F.struct("piece", F.expr("substring(text, cast(overlap as int) + 1)").alias("own"))
    fits = F.max(utf16_units(F.col("text"))) <= limit
    by = pieces.dropDuplicates(["page_id", "pos", "piece", "start"]).groupBy("page_id", "pos").agg(F.sort_array(F.collect_list(own)).alias("all"), fits.alias("within"))
    return by.select("page_id", "pos", F.array_join("all.own", "").alias("body"), F.size("all").cast("long").alias("pieces"), "within")
