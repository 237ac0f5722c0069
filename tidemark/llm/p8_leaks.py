"""Evaluation texts leaking into training text, by training suffix arrays.

Each shard of the corpus gets a suffix array over its words, made of the corpus alone: words are numbered by their hash, the
suffixes sorted by doubling. Every suffix of every evaluation passage is binary-searched in every shard; its longest match
in a document is with one of its two neighbours there. Documents with a match of at least MIN_WORDS words are reported and
can be removed. Nothing is shuffled but the hits: the corpus is read once, whatever the number of passages. An array that is
to be searched by several sets of passages can be written (`suffix_arrays`) and searched later (`search_arrays`).

Words are runs of letters and digits in lower case; two words count as equal if their 64-bit hashes are, and a match is
twelve of them in a row. Passages that are null, empty or shorter than MIN_WORDS words never match. Null and empty texts
hold nothing. The same passage under two ids is reported under both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

MIN_WORDS = 12
#: Words of a shard of which one suffix array is built.
SHARD_WORDS = 1_000_000
#: Words of evaluation passages that a task holds at a time, 16 bytes each; more are searched block by block in the same pass.
BLOCK_WORDS = 2_000_000
#: Words of evaluation passages that are sent to the corpus in one pass, about 320 MB; more take further passes.
PASS_WORDS = 20_000_000
#: Pairs of passage place and document that are worked on together.
PAIRS = 500_000
#: Word hashes kept by a worker; beyond, it starts anew.
CACHED_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, each in lower case. U+0130 is the one character whose lower case holds a non-letter."""
    if not text:
        return []
    return [w.lower() for w in WORD.findall(text)] if "İ" in text else WORD.findall(text.lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Passages:
    """A block of evaluation passages as hashed words, with the places where a match may begin."""

    def __init__(self, items: list[int], words: list[np.ndarray], least: int) -> None:
        self.least = least
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        self.item = np.repeat(np.array(items, np.int64), lengths)
        self.end = np.repeat(ends, lengths)
        self.first = np.zeros(len(self.words), bool)
        self.first[ends - lengths] = True
        self.begin = np.nonzero(self.end - np.arange(len(self.words)) >= least)[0]


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Places of a text of small numbers in the order of their suffixes.

    Suffixes are ordered by their first word, then by twice as many in each round; only groups that are still equal are
    sorted again. No suffix is the beginning of another if the text ends with a number that occurs once.
    """
    n = len(ranks)
    key = ranks * (int(ranks.max()) + 2)
    key[:-1] += ranks[1:] + 1  # the first two words at once
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # of a group, the place of its first
    width = 2
    open_ = np.nonzero(~(new & np.append(new[1:], True)))[0]
    while len(open_):
        at = order[open_]
        follow = at + width
        key = place[at] * (n + 1)
        key += np.where(follow < n, place[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[open_] = at = at[by]
        key = key[by]
        fresh = np.ones(len(at) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        place[at] = np.maximum.accumulate(np.where(fresh[:-1], open_, 0))
        open_ = open_[~(fresh[:-1] & fresh[1:])]
        width *= 2
    return order


class Shard:
    """Some documents of the corpus, one after another, as ranked words with their suffix array.

    After each document stands a number of its own, so no match goes on into the next one and no two suffixes are equal.
    """

    def __init__(self, docs: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: np.ndarray | None = None) -> None:
        self.docs, self.hashes, self.lengths = docs, hashes, lengths
        self.vocabulary, ranks = np.unique(hashes, return_inverse=True)
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.owner = np.repeat(np.arange(len(docs)), lengths + 1)
        self.words = np.empty(len(hashes) + len(docs), np.int64)
        ends = self.starts + lengths
        inner = np.ones(len(self.words), bool)
        inner[ends] = False
        self.words[inner] = ranks
        self.words[ends] = len(self.vocabulary) + np.arange(len(docs))
        self.order = suffix_order(self.words) if order is None else order

    def _longer(self, p: np.ndarray, c: np.ndarray, length: np.ndarray, passages: Passages, known: np.ndarray) -> np.ndarray:
        """Words that each passage place and corpus place have in common, of which `length` are known to be."""
        length = length.copy()
        live = np.arange(len(p))
        while len(live):
            a, b = p[live] + length[live], c[live] + length[live]
            on = a < passages.end[p[live]]
            live, a, b = live[on], a[on], b[on]
            live = live[known[a] == self.words[b]]
            length[live] += 1
        return length

    def _bounds(self, p: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the array of the suffixes that begin with the n words from p, by binary search."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), len(self.order), np.int64)
        for k in range(n):
            if k == 0:  # the array is sorted by first words, whose borders one search gives
                firsts = self.words[self.order]
                low, high = np.searchsorted(firsts, known[p], "left"), np.searchsorted(firsts, known[p], "right")
                continue
            wanted = known[p + k]
            low, high = self._narrow(low, high, wanted, k, False), self._narrow(low, high, wanted, k, True)
        return low, high

    def _narrow(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, k: int, beyond: bool) -> np.ndarray:
        """Within ranges of suffixes that agree in k words, the first whose next word is not less than the wanted one, or is greater."""
        low, high = low.copy(), high.copy()
        live = np.nonzero(low < high)[0]
        last = len(self.words) - 1
        while len(live):
            middle = (low[live] + high[live]) >> 1
            word = self.words[np.minimum(self.order[middle] + k, last)]
            right = word <= wanted[live] if beyond else word < wanted[live]
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]
            live = live[low[live] < high[live]]
        return low

    def _insertion(self, p: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray, passages: Passages) -> np.ndarray:
        """Where each passage suffix, cut at the passage's end, would stand among suffixes that agree with it in `least` words."""
        low, high = low.copy(), high.copy()
        live = np.nonzero(low < high)[0]
        while len(live):
            middle = (low[live] + high[live]) >> 1
            c = self.order[middle]
            n = self._longer(p[live], c, np.full(len(live), passages.least), passages, known)
            a, b = p[live] + n, c + n
            over = a >= passages.end[p[live]]  # the passage is at its end: it stands before all that go on
            right = ~over & (self.words[b] < known[np.minimum(a, len(known) - 1)])
            low[live[right]] = middle[right] + 1
            high[live[~right]] = middle[~right]
            live = live[low[live] < high[live]]
        return low

    def search(self, passages: Passages) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the document, item, words of the longest match, its place in the document) of documents and items, in parts.

        Of one document and item there may be several rows, of which the greatest holds. Places of passages and documents
        that go on to the left alike are left out, as the match that begins before is longer.
        """
        if not len(self.hashes) or not len(passages.begin):
            return
        least = passages.least
        at = np.minimum(np.searchsorted(self.vocabulary, passages.words), len(self.vocabulary) - 1)
        known = np.where(self.vocabulary[at] == passages.words, at, -1)
        bad = np.concatenate([[0], np.cumsum(known < 0)])
        p = passages.begin[bad[passages.begin + least] == bad[passages.begin]]
        low, high = self._bounds(p, known, least)
        p, low, high = p[high > low], low[high > low], high[high > low]
        if not len(p):
            return
        # equal heads have one range, and different ranges have no suffix in common
        begins, range_of = np.unique(low, return_inverse=True)
        stops = np.zeros(len(begins), np.int64)
        stops[range_of] = high
        sizes = stops - begins
        inside = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        of = np.repeat(np.arange(len(begins)), sizes)
        place = self.order[inside]
        # a range is left out if all that stands before its places, in passages and documents, is one and the same word
        before_c = np.where(place > 0, self.words[np.maximum(place - 1, 0)], -2)
        before_p = np.where(passages.first[p], -3, known[np.maximum(p - 1, 0)])
        edges = np.cumsum(sizes) - sizes
        one = np.minimum.reduceat(before_c, edges)
        same = one == np.maximum.reduceat(before_c, edges)
        other = np.zeros(len(begins), bool)
        other[range_of[before_p != one[range_of]]] = True
        keep = ~(same & ~other)
        chosen = keep[range_of]
        p, low, high, range_of = p[chosen], low[chosen], high[chosen], range_of[chosen]
        if not len(p):
            return
        spot = self._insertion(p, low, high, known, passages)
        # runs: the suffixes of one range and document, in the order of the array
        doc = self.owner[place]
        by = np.lexsort((inside, doc, of))
        of, doc, inside, place = of[by], doc[by], inside[by], place[by]
        opens = np.ones(len(by), bool)
        opens[1:] = (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])
        run_at = np.nonzero(opens)[0]
        run_of = np.cumsum(opens) - 1
        run_doc = doc[run_at]
        run_stop = np.append(run_at[1:], len(by))
        first_run = np.searchsorted(of[run_at], np.arange(len(begins)))
        runs = np.append(first_run[1:], len(run_at)) - first_run
        n = len(self.order) + 1
        keys = run_of * n + inside
        levels = _levels(place)
        counts = runs[range_of]
        upto = np.cumsum(counts)
        total = int(upto[-1])
        for begin in range(0, total, PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, total))
            row = np.searchsorted(upto, pair, "right")
            run = first_run[range_of[row]] + pair - (upto[row] - counts[row])
            near = np.searchsorted(keys, run * n + spot[row])
            q, begins_, stops_ = p[row], run_at[run], run_stop[run]
            best_n = np.zeros(len(pair), np.int64)
            for k in (near - 1, near):
                fits = np.nonzero((k >= begins_) & (k < stops_))[0]
                best_n[fits] = np.maximum(best_n[fits], self._longer(q[fits], place[k[fits]], np.full(len(fits), least), passages, known))
            d, item = run_doc[run], passages.item[q]
            by = np.lexsort((-best_n, item, d))
            d, item, best_n, q, near, begins_, stops_ = (x[by] for x in (d, item, best_n, q, near, begins_, stops_))
            top = np.ones(len(by), bool)
            top[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1])
            group = np.cumsum(top) - 1
            equal = best_n == best_n[top][group]
            group, best_n, q, near, begins_, stops_ = (x[equal] for x in (group, best_n, q, near, begins_, stops_))
            # places that share as much stand next to one another around `near`
            left, right = self._even(begins_, near, q, place, best_n, passages, known, True), self._even(near, stops_, q, place, best_n, passages, known, False)
            first = _range_least(levels, left, right)
            first = np.minimum.reduceat(first, np.searchsorted(group, np.arange(int(top.sum()))))
            yield d[top], item[top], np.maximum.reduceat(best_n, np.searchsorted(group, np.arange(int(top.sum())))), first - self.starts[d[top]]

    def _even(self, low: np.ndarray, high: np.ndarray, p: np.ndarray, place: np.ndarray, n: np.ndarray, passages: Passages, known: np.ndarray, left: bool) -> np.ndarray:
        """Border of the places that share n words with p: the first one in [low, high) from which all do, or the end of those that do."""
        low, high = low.copy(), high.copy()
        live = np.nonzero(low < high)[0]
        while len(live):
            middle = (low[live] + high[live]) >> 1
            long = self._longer(p[live], place[middle], np.full(len(live), passages.least), passages, known) >= n[live]
            down = long if left else ~long
            high[live[down]] = middle[down]
            low[live[~down]] = middle[~down] + 1
            live = live[low[live] < high[live]]
        return low


def _levels(values: np.ndarray) -> list[np.ndarray]:
    """Of each place the least of the 1, 2, 4, ... values from there."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _range_least(levels: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least value of each non-empty range."""
    height = np.floor(np.log2(end - begin)).astype(np.int64)
    out = np.empty(len(begin), np.int64)
    for k in np.unique(height):
        here = height == k
        out[here] = np.minimum(levels[k][begin[here]], levels[k][end[here] - (1 << k)])
    return out


def _shards(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, numbers of words, hashed words) of about SHARD_WORDS words; a longer document is a shard by itself."""
    hashes = WordHashes()
    docs: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if len(words) < least:
                continue
            docs.append(doc)
            parts.append(hashes.of(words))
            size += len(words)
            if size >= SHARD_WORDS:
                yield np.array(docs, np.int64), np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
                docs, parts, size = [], [], 0
    if parts:
        yield np.array(docs, np.int64), np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)


def _hits(shard: Shard, blocks: list[tuple[list[int], list[bytes]]], least: int) -> Iterator[pa.RecordBatch]:
    for items, raw in blocks:
        passages = Passages(items, [np.frombuffer(b, np.uint64) for b in raw], least)
        for d, item, n, first in shard.search(passages):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard.docs[d], item, n, first)], ["doc_id", "item_id", "match_words", "first_word"])


HITS = "doc_id long, item_id long, match_words long, first_word long"
ARRAYS = "docs array<long>, lengths array<long>, words binary, suffixes binary"


def _passes(items: DataFrame, id_col: str, text_col: str, least: int) -> Iterator[list[tuple[list[int], list[bytes]]]]:
    """Blocks of passages for each pass over the corpus, of bounded size, read row by row."""
    hashes = WordHashes()
    blocks: list[tuple[list[int], list[bytes]]] = []
    ids: list[int] = []
    raw: list[bytes] = []
    size = total = 0
    for row in items.select(F.col(id_col).cast("long"), text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct().toLocalIterator():
        words = words_of(row[1])
        if len(words) < least:
            continue
        if ids and size + len(words) > BLOCK_WORDS:
            blocks.append((ids, raw))
            ids, raw, size = [], [], 0
        if blocks and total + len(words) > PASS_WORDS:
            yield blocks
            blocks, total = [], size
        ids.append(row[0])
        raw.append(hashes.of(words).tobytes())
        size += len(words)
        total += len(words)
    if ids:
        blocks.append((ids, raw))
    if blocks:
        yield blocks


def _best(hits: list[DataFrame], documents: DataFrame) -> DataFrame:
    if not hits:
        return documents.sparkSession.createDataFrame([], HITS)
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.max("match_words").alias("match_words"), F.max_by("first_word", F.struct("match_words", -F.col("first_word"))).alias("first_word"))


def _texts(documents: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("text is not null and doc is not null")


def leaked_items(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, match_words, first_word): the longest verbatim match of each document and item, of `least` words or more.

    first_word is the 0-based place of the match in the document's words. With no passages the result is empty. Arrays are
    built and searched in one pass over the corpus and not kept.
    """

    def run(sent):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, least):
                yield from _hits(Shard(*shard), sent.value, least)

        return rows

    texts, context = _texts(documents, doc_col, text_col), documents.sparkSession.sparkContext
    return _best([texts.mapInArrow(run(context.broadcast(blocks)), HITS) for blocks in _passes(items, item_col, passage_col, least)], documents)


def suffix_arrays(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(docs, lengths, words, suffixes): one row a shard, to be written and searched by any passages of at least `least` words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, lengths, hashes in _shards(batches, least):
            order = Shard(docs, lengths, hashes).order.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([hashes.tobytes()], pa.binary()), pa.array([order.tobytes()], pa.binary())], ["docs", "lengths", "words", "suffixes"])

    return _texts(documents, doc_col, text_col).mapInArrow(rows, ARRAYS)


def search_arrays(arrays: DataFrame, items: DataFrame, item_col: str = "item_id", passage_col: str = "passage", least: int = MIN_WORDS) -> DataFrame:
    """What leaked_items gives, from written suffix arrays."""

    def run(sent):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    docs, lengths = (np.asarray(batch.column(k)[i].values) for k in range(2))
                    words, order = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), np.frombuffer(batch.column(3)[i].as_buffer(), np.int32).astype(np.int64)
                    yield from _hits(Shard(docs, lengths, words, order), sent.value, least)

        return rows

    context = arrays.sparkSession.sparkContext
    return _best([arrays.select("docs", "lengths", "words", "suffixes").mapInArrow(run(context.broadcast(blocks)), HITS) for blocks in _passes(items, item_col, passage_col, least)], arrays)


def without_leaks(documents: DataFrame, leaks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The documents that hold no passage."""
    return documents.join(leaks.select(F.col("doc_id").alias(doc_col)).distinct(), doc_col, "left_anti")
