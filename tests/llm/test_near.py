import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import p4_near as P
from tidemark.sources.scratch import Scratch

SCHEMA = "page_id long, markdown string"


def runs(text, n=3):
    w = P.words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def sample(n=160, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    shared = " ".join(rng.choice(words) for _ in range(45))  # lines that many pages carry
    rows = []
    while len(rows) < n:
        text = [rng.choice(words) for _ in range(rng.randint(80, 220))]
        if rng.random() < 0.5:
            text += shared.split()
        rows.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3])):
            t = list(text)
            for _ in range(rng.randint(0, 9)):
                i = rng.randrange(len(t))
                t[i : i + rng.randint(0, 2)] = [rng.choice(words)]
            if rng.random() < 0.3:
                t = t[40:] + t[:40]
            rows.append(" ".join(t))
    return list(enumerate(rows))


def brute(rows, threshold=0.7, least=100):
    sets = {p: runs(t) for p, t in rows if t is not None and len(P.words_of(t)) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_code():
    code = P.Golay()
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    row, index = code.nearby(words)
    sizes = Counter(np.bincount(row).tolist())
    assert set(sizes) == {1, 6} and 0.10 < sizes[1] / 4000 < 0.17
    near = words.copy()
    for _ in range(2):
        near ^= 1 << rng.integers(0, 23, 4000)
    keys, others = set(zip(row.tolist(), index.tolist())), set(zip(*(x.tolist() for x in code.nearby(near))))
    assert {r for r, _ in keys & others} == set(range(4000))  # words at most 2 bits apart share a codeword


def missed(union, common, pairs, seed=3):
    """Of random pairs of sets with `common` of `union` runs in both, how many share no segment that makes them candidates."""
    rng = np.random.default_rng(seed)
    made, code = P.Fingerprints(3), P.Golay()
    own = (union - common) // 2
    found = np.zeros(pairs, bool)
    for at in range(0, pairs, 1000):
        n = min(1000, pairs - at)
        runs = rng.integers(0, 1 << 63, (n, common + 2 * own), dtype=np.uint64)
        offsets = np.arange(0, n * (common + own) + 1, common + own)
        prints = [made.prints(offsets, np.sort(x, axis=1).ravel()) for x in (runs[:, : common + own], np.concatenate([runs[:, :common], runs[:, common + own :]], axis=1))]
        pair, k = np.nonzero(prints[0][1] == prints[1][1])
        x, y = (p[2][pair, k] for p in prints)
        shared = set.intersection(*(set(zip(*(v.tolist() for v in code.nearby(w)))) for w in (x, y)))
        near = np.zeros(len(pair), bool)
        near[[r for r, _ in shared]] = True
        near &= np.bitwise_count(x ^ y) <= P.ERRORS
        found[at + pair[near]] = True
    return pairs - int(found.sum())


def test_recall_at_the_threshold():
    """At most 1 in 1,000 pairs at the threshold and none a little above it may be lost."""
    assert missed(100, 70, 6000) <= 6 and missed(100, 76, 6000) == 0


def test_against_brute_force(spark):
    rows = sample()
    expected = brute(rows)
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:5])]  # copies
    expected = brute(rows)
    df = spark.createDataFrame(rows + rows[:30], SCHEMA)
    near = P.NearDuplicates(df)
    got = [tuple(r) for r in near.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) <= expected and len(set(got)) >= 0.99 * len(expected)
    links = Counter(x for pair in got for x in pair)
    groups = {r.page_id: (r.group_id, r.links) for r in near.groups().collect()}
    parent = {p: p for p in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert groups == {p: (root(p), links[p]) for p in groups}


def test_cases(spark):
    base = " ".join(f"a{i}" for i in range(100))
    rows = [(1, base), (2, base.upper() + "!"), (3, " ".join(base.split()[:99])), (4, None), (5, ""), (None, base), (6, "x " * 400_000), (7, "x " * 300)]
    near = P.NearDuplicates(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "node", "text", "names", "a", "b")}))
    # texts of fewer than 100 words take no part; runs of one word only are one and the same set
    assert {tuple(r) for r in near.pairs().collect()} == {(1, 2), (6, 7)}
    assert {r.page_id for r in near.groups().collect()} == {1, 2, 6, 7}
    empty = P.NearDuplicates(spark.createDataFrame([], SCHEMA))
    assert empty.pairs().isEmpty() and empty.groups().isEmpty()


def test_many_copies(spark):
    base = " ".join(f"a{i}" for i in range(120))
    rows = [(i, base) for i in range(60)] + [(100, base + " one more word"), (101, " ".join(f"b{i}" for i in range(120)))]
    near = P.NearDuplicates(spark.createDataFrame(rows, SCHEMA))
    assert near.pairs().count() == 60 * 59 // 2 + 60
    groups = {r.page_id: (r.group_id, r.links) for r in near.groups().collect()}
    assert groups[0] == (0, 60) and groups[100] == (0, 60) and groups[101] == (101, 0)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in P.connected_components(links, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_exact(spark):
    """The join of prefixes loses no pair, those just at the threshold included."""
    rng = random.Random(4)
    rows = sample()
    for k in range(40):  # pairs of sets of 100 runs with 82 or 83 in common: similarities of 0.695 and 0.709
        words = [f"e{k}x{i}" for i in range(102)]
        cut = rng.choice([82, 83, 84])
        rows += [(5000 + 2 * k, " ".join(words)), (5001 + 2 * k, " ".join(words[: cut + 2] + [f"f{k}x{i}" for i in range(100 - cut)]))]
    df = spark.createDataFrame(rows + rows[:9], SCHEMA)
    expected = brute(rows)
    assert {tuple(r) for r in P.NearDuplicates(df, exact=True).pairs().collect()} == expected
    assert P.NearDuplicates(df.limit(0), exact=True).pairs().isEmpty()


def test_many_copies_are_spread(spark):
    """What p4_found expands: k equal copies are one node, and k (k - 1) / 2 rows of its pairs come from a join that skew handling can split on both sides."""
    base = " ".join(f"a{i}" for i in range(120))
    near = P.NearDuplicates(spark.createDataFrame([(i, base) for i in range(300)], SCHEMA))
    assert near.members.select("node").distinct().count() == 1 and near.links.isEmpty()
    assert near.pairs().count() == 300 * 299 // 2
