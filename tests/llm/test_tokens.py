import random
import time
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import p7_tokens as P

pytestmark = pytest.mark.skipif(not Path(P.TOKENIZER).exists(), reason="needs the public vocabulary")


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(P.TOKENIZER)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = random.Random(7)
    out = ["", " ", "a", "<|endoftext|> x", "don't 'll  x's\n\n y", "\x1c\x1d a\x1f", "a" * 5000, " " * 3000 + "x", "日本語のテキスト。", "\r\n\tx  \r\n", "😀👨‍👩‍👧 é", "\U00033337'll"]
    out += ["".join(rng.choice("ab '\n\t .,é9日　\xa0😀") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    out += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}'s" for c in [*range(0x3100), *rng.sample(range(0x3100, 0xD800), 1500), *rng.sample(range(0xE000, 0x110000), 1500)]]
    return out


def test_equals_the_tokenizer(exact):
    sample = texts()
    bounds, ids = P.CorpusEncoder().encode(sample)
    expected = exact(sample)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == expected


def test_proposals_are_told_right():
    e = P.SpeculativeEncoder()
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdluABCé9") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    e.learn(words)
    failing = 0
    for w in words:
        exact, greedy = e.merge(w.encode()), e.propose(w.encode())
        assert e.words[w] == exact
        stands = all(e.compatible[a << 32 | b] for a, b in zip(greedy, greedy[1:]))
        assert stands == (greedy == exact)
        failing += not stands
    assert 0 < failing < len(words)


def test_cache_starts_anew(exact, monkeypatch):
    monkeypatch.setattr(P, "CACHED_CHUNKS", 50)
    e = P.CorpusEncoder()
    sample = texts()[:300]
    got = []
    for i in range(0, len(sample), 20):
        bounds, ids = e.encode(sample[i : i + 20])
        got += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == exact(sample)


def test_corpus(spark, smallest, exact):
    rows = pq.read_table(f"{smallest}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: list(r.ids) for r in P.encode_corpus(spark.read.parquet(f"{smallest}/documents.parquet")).collect()}
    assert got == {r["doc_id"]: i for r, i in zip(rows, exact([r["text"] or "" for r in rows]))}


def test_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (4, "word " * 1_000_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = P.encode_corpus(df).collect()
    assert [r.ids for r in got[:2]] == [[], []] and got[2] == got[3] and got[4].doc_id is None and len(got[5].ids) >= 1_000_000
    assert P.encode_corpus(df.limit(0)).isEmpty()


def test_long_words(exact):
    """A word without blanks takes time in proportion, but for a logarithm, and gives what the tokenizer gives."""
    rng = random.Random(9)
    words = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (5_000, 100_000)]
    words += ["a" * 30_000, "ab" * 20_000, "缓存页面" * 10_000]
    began = time.monotonic()
    bounds, ids = P.CorpusEncoder().encode(words)
    assert time.monotonic() - began < 30
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == exact(words)
    e = P.SpeculativeEncoder()
    began = time.monotonic()
    e.merge("".join(rng.choice("abcdefghij") for _ in range(1_000_000)).encode())
    assert time.monotonic() - began < 60
