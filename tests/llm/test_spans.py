import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import p9_spans as P

SCHEMA = "doc_id long, text string"


def brute(rows, span):
    texts = {d: t for d, t in rows if d is not None and t is not None}
    on = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            on[t[i : i + span]].add(d)
    out = set()
    for d, t in texts.items():
        end = start = None
        for i in range(len(t) - span + 1):
            if len(on[t[i : i + span]]) > 1:
                if end is None or i > end:
                    if end is not None:
                        out.add((d, start, end))
                    start = i
                end = i + span
        if end is not None:
            out.add((d, start, end))
    return out


def sample(seed, n=40):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcd é😀\n") for _ in range(rng.randint(20, 300))) for _ in range(8)]
    rows = []
    for d in range(n):
        text = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 120)))
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(pool)
            a = rng.randint(0, len(piece) - 1)
            text += piece[a : a + rng.randint(1, 300)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))
        rows.append((d, text))
    return rows + [(n, "ab" * 300), (n + 1, "ab" * 200 + "c"), (n + 2, "a" * 500), (n + 3, "a" * 100), (n + 4, None), (n + 5, ""), (n + 6, rows[0][1])]


@pytest.mark.parametrize("seed, block", [(1, 1 << 20), (2, 1 << 20), (3, 256), (4, 128)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(P, "PART", 8)
    rows = sample(seed)
    expected = brute(rows, 60)
    df = spark.createDataFrame(rows + rows[:7], SCHEMA)
    if block < 1 << 20:  # pieces that overlap; the workers get the block size with the function
        got = in_pieces(rows, 60, 20, block)
        assert got == expected
    assert {tuple(r) for r in P.shared_spans(df, span=60, unit=20).collect()} == expected and expected


def in_pieces(rows, span, unit, block):
    """Windows from small pieces: each window of a text lies in one of its pieces."""
    old, P.BLOCK = P.BLOCK, block
    try:
        on, at = defaultdict(set), defaultdict(set)
        for b, _ in P._blocks(iter([(d, t, None) for d, t in rows]), span):
            place, digest, first, last = b.units(span, unit)
            doc = b.place(place)[0]
            for k, d in enumerate(doc.tolist()):
                for w in range(first[k], last[k] + 1):
                    start = int(b.place(np.array([w]))[1][0])
                    text = dict(rows)[d][start : start + span]
                    on[text].add(d)
                    at[d].add((start, text))
    finally:
        P.BLOCK = old
    out = set()
    for d, windows in at.items():
        end = start = None
        for i, text in sorted(windows):
            if len(on[text]) > 1:
                if end is None or i > end:
                    if end is not None:
                        out.add((d, start, end))
                    start = i
                end = i + span
        if end is not None:
            out.add((d, start, end))
    return out


def test_cases(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, text), (1, text), (2, "x" * 100 + text[100:419] + "y"), (3, "z" + text[200:520]), (4, text[:319]), (None, text), (5, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("doc", "digest", "first", "units")})
    spans = P.shared_spans(df)
    assert {tuple(r) for r in spans.collect()} == {(1, 200, 520), (3, 1, 321)}  # 319 characters are one too few
    portion = {r.doc_id: (r.n_chars, r.shared_chars, round(r.share, 4)) for r in P.shared_portion(df.filter("doc_id is not null"), spans).collect()}
    assert portion == {1: (700, 320, 0.4571), 2: (420, 0, 0.0), 3: (321, 320, 0.9969), 4: (319, 0, 0.0), 5: (0, 0, 0.0)}
    assert P.shared_spans(df.limit(0)).isEmpty()


def test_many_copies_and_long_texts(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(i, base) for i in range(50)] + [(100, long), (101, long[500_000:1_100_000]), (102, base[:500] + "!" + base[500:])]
    got = {tuple(r) for r in P.shared_spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, 0, 1000) for i in range(50)} | {(100, 500_000, 1_100_000), (101, 0, 600_000), (102, 0, 500), (102, 501, 1001)}


def test_paragraphs(spark):
    p = "A paragraph that is long enough to count as one here."
    rows = [(2, f"own words of the second document, which are long\n\n{p}"), (1, f"{p.upper()}\n\nshort\n\n{p}  "), (3, None), (4, ""), (1, f"{p.upper()}\n\nshort\n\n{p}  ")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in P.repeated_paragraphs(df).collect()}
    n = len(p)
    assert got == {(1, n + 9, 2 * n + 11, 1, 0), (2, 50, 50 + n, 1, 0)}
    assert P.repeated_paragraphs(df.limit(0)).isEmpty()
