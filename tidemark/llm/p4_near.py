"""Near-duplicate records with small edits, by Golay-code fuzzy hashing.

A text's set of word runs is fingerprinted in segments of 23 bits, one bit each of 23 minimum hashes. The binary Golay
code (23, 12) is perfect: every segment has one codeword within 3 errors, and decoding the segment with each single bit
flipped gives its one to six nearby codewords. Two segments that differ in at most 2 bits share one of them. Over all
segments the errors of a similar pair spread out, so by the pigeonhole principle some segment has few.

A codeword index has 12 bits only, so the index alone would put a fixed share of a growing collection into each bucket.
Each segment's bucket is therefore named by three full minimum hashes, and the codeword indices split the buckets that
hold more than one set: lines that a site repeats put many of its pages into one bucket, but not their codewords.
Records with equal sets are one node throughout. Candidates are first held against each other by 4 bits of each minimum
hash, then verified on the whole sets.

The segments draw on the same HASHES minimum hashes and so fail together more often than independent ones; the fewer the
hashes, the more so. Measured on random pairs of sets, 40,000 a level, with 64 segments on 256 hashes: 2 pairs of similarity
0.70 aren't candidates, 2 of 0.72, none of 0.75; the sketch, not counted there, loses one in 30,000.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.p1_lines import limited
from tidemark.llm.p8_leaks import words_of
from tidemark.sources.scratch import Scratch

SEGMENTS = 64
BITS = 23
HASHES = 256
NAMES = 3
#: Minimum hashes of which the sketch holds 4 bits each.
SKETCHED = 64
#: Differing bits of a segment up to which two sets that share a codeword are candidates.
ERRORS = 5
#: Word hashes kept by a worker; beyond, it starts anew.
CACHED_WORDS = 2_000_000
#: Words worked on together.
BLOCK_WORDS = 500_000
#: Sets hashed together, so that their runs stay in the cache over all hashes.
BLOCK_SETS = 64
#: The code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


class Golay:
    """Decoding of 23-bit words to the 12-bit indices of their codewords."""

    def __init__(self) -> None:
        self.parts = np.array([self._rest(1 << i) for i in range(BITS)], np.int32)
        self.errors = np.zeros(1 << 11, np.int32)  # by syndrome; the code is perfect, so each has one pattern of at most 3 errors
        for n in range(1, 4):
            for bits in itertools.combinations(range(BITS), n):
                self.errors[np.bitwise_xor.reduce(self.parts[list(bits)])] = sum(1 << b for b in bits)

    @staticmethod
    def _rest(word: int) -> int:
        for i in range(BITS - 1, 10, -1):
            if word >> i & 1:
                word ^= GENERATOR << (i - 11)
        return word

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int32)
        for i in range(BITS):
            out ^= np.where(words >> i & 1, self.parts[i], 0).astype(np.int32)
        return out

    def nearby(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of each distinct codeword near each word: those to which it decodes as it is or with one bit flipped."""
        words = words.astype(np.int32)
        base = self.syndromes(words)
        grid = np.empty((len(words), BITS + 1), np.int32)
        grid[:, 0] = (words ^ self.errors[base]) >> 11
        for i in range(BITS):
            grid[:, i + 1] = (words ^ (1 << i) ^ self.errors[base ^ self.parts[i]]) >> 11
        grid.sort(axis=1)
        new = np.ones(grid.shape, bool)
        new[:, 1:] = grid[:, 1:] != grid[:, :-1]
        row, column = np.nonzero(new)
        return row, grid[row, column]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h


class Fingerprints:
    """Sets of runs of `run` words, and their fingerprints. Everything is a function of the set alone."""

    def __init__(self, run: int, seed: int = 20) -> None:
        self.run = run
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        self.places = rng.integers(0, 1 << 63, run, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        # as many segments as a permutation holds share no hash, and no hash stands in many more segments than another
        width = NAMES + BITS
        pieces = HASHES // width
        rounds = [rng.permutation(HASHES) for _ in range(-(-SEGMENTS // pieces))]
        self.drawn = [p[k * width : (k + 1) * width] for p in rounds for k in range(pieces)][:SEGMENTS]
        self.bit = rng.integers(8, 56, (SEGMENTS, BITS), dtype=np.uint64)
        self._words = _WordHashes()

    def sets(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets, one more than texts, and the sorted distinct run hashes of all texts."""
        if len(self._words) > CACHED_WORDS:
            self._words.clear()
        get = self._words.__getitem__
        out = []
        for words in texts:
            h = np.fromiter(map(get, words), np.uint64, len(words))
            n = max(0, len(h) - self.run + 1)
            mix = np.zeros(n, np.uint64)
            for k in range(self.run):
                mix += _mixed(h[k : k + n] + np.uint64(k)) * self.places[k]
            out.append(np.unique(_mixed(mix)))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
        return offsets, np.concatenate(out) if out else np.empty(0, np.uint64)

    def _least(self, offsets: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The minimum hashes of non-empty sets, a row a hash."""
        least = np.empty((HASHES, len(offsets) - 1), np.uint64)
        for first in range(0, len(offsets) - 1, BLOCK_SETS):
            ends = offsets[first : first + BLOCK_SETS + 1]
            x, starts = runs[ends[0] : ends[-1]], ends[:-1] - ends[0]
            y, z = np.empty_like(x), np.empty_like(x)
            for j in range(HASHES):
                np.multiply(x, self.factor[j], out=y)
                np.add(y, self.shift[j], out=y)
                np.right_shift(y, np.uint64(32), out=z)
                np.bitwise_xor(y, z, out=y)
                np.multiply(y, np.uint64(0xD6E8FEB86659FD93), out=y)
                np.right_shift(y, np.uint64(29), out=z)
                np.bitwise_xor(y, z, out=y)
                least[j, first : first + BLOCK_SETS] = np.minimum.reduceat(y, starts)
        return _mixed(least)

    def prints(self, offsets: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest of each set, bucket names, segments, sketch) of non-empty sets; names and segments have a column a segment, the sketch 16 minimum hashes a column."""
        starts = offsets[:-1]
        digest = _mixed(np.add.reduceat(_mixed(runs), starts) + np.diff(offsets).astype(np.uint64))
        least = self._least(offsets, runs)
        names = np.empty((len(starts), SEGMENTS), np.uint64)
        segments = np.zeros((len(starts), SEGMENTS), np.int32)
        for s in range(SEGMENTS):
            names[:, s] = s
            for j in self.drawn[s][:NAMES]:
                names[:, s] = _mixed(names[:, s] + least[j])
            for k, j in enumerate(self.drawn[s][NAMES:]):
                segments[:, s] |= ((least[j] >> self.bit[s, k] & np.uint64(1)) << np.uint64(k)).astype(np.int32)
        sketch = np.zeros((len(starts), SKETCHED // 16), np.uint64)
        for j in range(SKETCHED):
            sketch[:, j // 16] |= (least[j] & np.uint64(15)) << np.uint64(4 * (j % 16))
        return digest, names, segments, sketch


def _texts(batch: pa.RecordBatch, least_words: int) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Blocks of (ids, words) of the texts that have least_words words."""
    ids, texts, size = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = words_of(text)
        if len(words) < least_words:
            continue
        ids.append(key)
        texts.append(words)
        size += len(words)
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _print_rows(run: int, least_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(run)
        for batch in batches:
            for ids, texts in _texts(batch, least_words):
                digest, *columns = made.prints(*made.sets(texts))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64) if x.dtype == np.uint64 else x.ravel())) for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digest.view(np.int64)), *lists], ["id", "node", "names", "segments", "sketch"])

    return rows


def _set_rows(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprints(run)
        for batch in batches:
            for nodes, texts in _texts(batch, 0):
                offsets, runs = made.sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(runs.view(np.int64)))], ["node", "runs"])

    return rows


def _codeword_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        name, segment = (np.asarray(batch.column(k)) for k in range(2))
        row, index = code.nearby(segment)
        key = _mixed(name.view(np.uint64)[row] + _mixed(index.astype(np.uint64) + np.uint64(1)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(name[row]), pa.array(segment[row])], ["key", "name", "segment"])


def fingerprints(pages: DataFrame, id_col: str, text_col: str, run: int, least_words: int) -> DataFrame:
    """(id, node, names, segments, sketch) of the texts of at least least_words words; node is the digest of the set."""
    texts = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (F.length("text") >= 2 * least_words - 1))
    return texts.mapInArrow(_print_rows(run, least_words), "id long, node long, names array<long>, segments array<int>, sketch array<long>")


def candidate_nodes(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: nodes that share a bucket and in its segment are equal, or share a codeword and differ in few bits.

    Codewords are joined between the distinct segments of a bucket, not between its nodes, so many records that differ
    little give one pair of segments; those are then expanded to their nodes once.
    """
    nodes = prints.select("node", "names", "segments").dropDuplicates(["node"])
    rows = nodes.select("node", F.explode(F.arrays_zip("names", "segments")).alias("x")).select(F.col("x.names").alias("name"), F.col("x.segments").alias("segment"), "node")
    shared = rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    kept = scratch.keep(rows.join(shared, "name", "left_semi").select("name", "segment", "node"), "rows")
    x, y = kept.alias("x"), kept.alias("y")
    equal = x.join(y, (F.col("x.name") == F.col("y.name")) & (F.col("x.segment") == F.col("y.segment")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    keyed = kept.select("name", "segment").distinct().mapInArrow(_codeword_rows, "key long, name long, segment int")
    p, q = keyed.alias("p"), keyed.alias("q")
    few = F.bit_count(F.col("p.segment").bitwiseXOR(F.col("q.segment"))) <= ERRORS
    near = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.name") == F.col("q.name")) & (F.col("p.segment") < F.col("q.segment")) & few)
    pairs = near.select("p.name", F.col("p.segment").alias("s"), F.col("q.segment").alias("t")).distinct()
    left, right = (kept.select("name", F.col("segment").alias(c), F.col("node").alias(f"{c}_node")) for c in "st")
    unlike = pairs.join(left, ["name", "s"]).join(right, ["name", "t"]).select(F.least("s_node", "t_node").alias("a"), F.greatest("s_node", "t_node").alias("b"))
    return equal.unionByName(unlike).distinct()


def _equal_hashes(a: Column, b: Column) -> Column:
    """How many of the sketched minimum hashes agree in their 4 bits."""

    def in_word(k: int) -> Column:
        x = a[k].bitwiseXOR(b[k])
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return 16 - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((in_word(k) for k in range(1, SKETCHED // 16)), in_word(0))


def sketched(candidates: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose sketches agree as a pair at the threshold does, less four standard deviations."""
    share = threshold + (1 - threshold) / 16
    least = SKETCHED * share - 4 * (SKETCHED * share * (1 - share)) ** 0.5
    left, right = (sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch")) for c in "ab")
    return candidates.join(left, "a").join(right, "b").filter(_equal_hashes(F.col("a_sketch"), F.col("b_sketch")) >= least).select("a", "b")


def exact_candidates(sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: a superset of all pairs of nodes whose sets (node, runs) are alike beyond the threshold, without exception.

    Two sets of similarity t share a run among the rarest n - ceil(t n) + 1 of each, whatever the order of runs is as long as it is
    one for all. Runs are ordered by how many sets hold them; those that one set alone holds fill places and are never joined.
    """
    runs = sets.select("node", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    held = runs.groupBy("run").agg(F.count("*").alias("held"))
    by = Window.partitionBy("node").orderBy("held", "run")
    # the least bit of room keeps a product that should be whole from being rounded up
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    rare = runs.join(held, "run").withColumn("place", F.row_number().over(by)).filter((F.col("place") <= prefix) & (F.col("held") > 1)).select("run", "node", "n")
    kept = scratch.keep(rare, "prefixes")
    x, y = kept.alias("x"), kept.alias("y")
    sizes = (F.col("x.n") >= F.col("y.n") * threshold - 1e-9) & (F.col("y.n") >= F.col("x.n") * threshold - 1e-9)
    return x.join(y, (F.col("x.run") == F.col("y.run")) & (F.col("x.node") < F.col("y.node")) & sizes).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


class NearDuplicates:
    """The stages of one run over `pages`; `members` and `links` are written tables.

    With `exact` the index of codewords gives way to a join of prefixes, which loses no pair but moves every set; the index alone
    misses about one pair in 20,000 at the threshold.

    members: (id, node), a row for each id that has at least least_words words. links: (a, b, similarity) between nodes
    a < b whose sets have a Jaccard similarity of at least `threshold`. Texts that are null, empty or too short take no part.
    Equal rows count once.
    """

    def __init__(self, pages: DataFrame, id_col: str = "page_id", text_col: str = "markdown", run: int = 3, threshold: float = 0.7, least_words: int = 100, exact: bool = False) -> None:
        self.id_col = id_col
        scratch = self._scratch = Scratch(pages.sparkSession, "p4")
        prints = scratch.keep(fingerprints(pages, id_col, text_col, run, least_words), "prints")
        self.members = scratch.keep(prints.select("id", "node").distinct(), "members")
        if exact:
            every = self.members.groupBy("node").agg(F.min("id").alias("id"))
            whole = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(every, "id").dropDuplicates(["node"]).select("node", "text")
            candidates = exact_candidates(scratch.keep(whole.mapInArrow(_set_rows(run), "node long, runs array<long>"), "every"), threshold, scratch)
        else:
            sketches = prints.select("node", "sketch").dropDuplicates(["node"])
            candidates = sketched(candidate_nodes(prints, scratch), sketches, threshold)
        candidates = scratch.keep(candidates, "candidates")
        scratch.drop("prints", "rows", "every", "prefixes")
        needed = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).distinct()
        chosen = scratch.keep(self.members.join(needed, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "chosen")
        texts = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        once = texts.join(limited(chosen), "id").dropDuplicates(["node"]).select("node", "text")
        sets = scratch.keep(once.mapInArrow(_set_rows(run), "node long, runs array<long>"), "sets")
        left, right = (sets.select(F.col("node").alias(c), F.col("runs").alias(f"{c}_runs")) for c in "ab")
        both = candidates.join(left, "a").join(right, "b").select("a", "b", F.size("a_runs").alias("n"), F.size("b_runs").alias("m"), F.size(F.array_intersect("a_runs", "b_runs")).alias("common"))
        scored = both.withColumn("similarity", F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).filter(F.col("similarity") >= threshold)
        self.links = scratch.keep(scored.select("a", "b", "similarity"), "links")
        scratch.drop("candidates", "chosen", "sets")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs of alike records, equal ones too. This is the one place where groups are expanded."""
        m = self.members
        equal = m.alias("x").join(m.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
        alike = self.links.join(m.select(F.col("node").alias("a"), F.col("id").alias("p")), "a").join(m.select(F.col("node").alias("b"), F.col("id").alias("q")), "b").select("p", "q").filter("p != q")
        return equal.unionByName(alike).select(F.least("p", "q").alias(f"{self.id_col}_a"), F.greatest("p", "q").alias(f"{self.id_col}_b"))

    def groups(self) -> DataFrame:
        """One row a record: (id, group_id, links); group_id is the least id of its connected component, links the number of other records alike.

        Records alone are their own group with no links.
        """
        sizes = self.members.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        ends = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        far = ends.join(sizes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("far"))
        roots = connected_components(self.links, self._scratch)
        nodes = sizes.join(far, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        firsts = nodes.groupBy("root").agg(F.min("first").alias("group_id"))
        of = nodes.join(firsts, "root").select("node", "group_id", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
        return self.members.join(of, "node").select(F.col("id").alias(self.id_col), "group_id", "links")


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of all nodes in links (a, b), by alternating large and small stars; each round is written, so lineage stays short.

    Only ids of edges move; no neighbourhood is ever gathered in one place, as each star step is a minimum and a join.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges0")
    k = 0
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = scratch.keep(large.filter("v != u").distinct(), f"large{k}")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(joined.select("v", F.col("m").alias("u"))).filter("v != u").distinct()
        after = scratch.keep(small, f"edges{k + 1}")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        scratch.drop(f"edges{k}", f"large{k}")
        edges, k = after, k + 1
        if same:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
