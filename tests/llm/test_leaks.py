import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm import p8_leaks as P


def brute(docs, items, least=12):
    out = {}
    for d, text in docs:
        a = P.words_of(text)
        for i, passage in items:
            b = P.words_of(passage)
            best = 0
            for x in range(len(b)):
                for y in range(len(a)):
                    n = 0
                    while x + n < len(b) and y + n < len(a) and b[x + n] == a[y + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = best
    return out


def sample():
    rng = random.Random(9)
    words = ["the", "cache", "page", "of", "a", "key", "is", "read", "and", "Was"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "x")]
    items.append((60, items[0][1] + " and some more words to make it long enough for all"))
    items.append((61, items[-1][1]))
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            w = rng.choice([t for _, t in items if t]).split()
            cut = rng.randint(0, max(0, len(w) - 11))
            text[10:10] = w[cut:]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(text).upper() if d % 2 else " ".join(text)))
    return docs + [(90, None), (91, "")], items


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return P.leaked_items(d, spark.createDataFrame(items, "item_id long, passage string"))


@pytest.mark.parametrize("block, together", [(2_000_000, 20_000_000), (60, 100), (60, 60)])
def test_against_brute_force(spark, monkeypatch, block, together):
    monkeypatch.setattr(P, "BLOCK_WORDS", block)
    monkeypatch.setattr(P, "PASS_WORDS", together)
    docs, items = sample()
    found = leaks(spark, docs + docs[:10], items + items[:3])
    got = {(r.doc_id, r.item_id): r.match_words for r in found.collect()}
    assert got == brute(docs, items) and got
    for r in found.collect():
        words, passage = P.words_of(dict(docs)[r.doc_id]), P.words_of(dict(items)[r.item_id])
        part = words[r.first_word : r.first_word + r.match_words]
        assert any(passage[k : k + len(part)] == part for k in range(len(passage)))


def hits(docs, items, least=12):
    """Longest matches straight from the shards."""
    hashes = P.WordHashes()
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc", "text"])
    words = [(i, P.words_of(t)) for i, t in items]
    blocks = [([i for i, w in words if len(w) >= least], [hashes.of(w).tobytes() for _, w in words if len(w) >= least])]
    out = {}
    for shard in P._shards(iter([batch]), least):
        for rows in P._hits(P.Shard(*shard), blocks, least):
            for r in rows.to_pylist():
                key = r["doc_id"], r["item_id"]
                out[key] = max(out.get(key, 0), r["match_words"])
    return out


@pytest.mark.parametrize("shard, pairs", [(40, 500_000), (1_000_000, 7), (300, 1)])
def test_small_shards(monkeypatch, shard, pairs):
    docs, items = sample()
    monkeypatch.setattr(P, "SHARD_WORDS", shard)
    monkeypatch.setattr(P, "PAIRS", pairs)
    assert hits(docs, items) == brute(docs, items)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=30), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("abc"), max_size=20), min_size=1, max_size=5))
def test_few_words(docs, items):
    """Two words over and over make long and many matches."""
    docs, items = [(i, " ".join(d)) for i, d in enumerate(docs)], [(i, " ".join(d)) for i, d in enumerate(items)]
    assert hits(docs, items, 3) == brute(docs, items, 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_suffix_order(numbers):
    ranks = np.array([*numbers, 9], np.int64)
    assert P.suffix_order(ranks).tolist() == sorted(range(len(ranks)), key=lambda i: ranks[i:].tolist())


def test_common_sentence():
    """One sentence in 2,000 passages and 5,000 documents: pairs are worked on in parts, and only those that begin at its start."""
    rng = random.Random(3)
    common = " ".join(f"c{k}" for k in range(15))
    docs = [(d, f"d{rng.random()} {common} e{rng.random()}") for d in range(5000)] + [(5000, "a " * 2000)]
    items = [(i, f"p{rng.random()} {common} q{rng.random()}") for i in range(2000)] + [(2000, "a " * 2000)]
    hashes = P.WordHashes()
    shard = next(P._shards(iter([pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc", "text"])]), 12))
    passages = P.Passages([i for i, _ in items], [hashes.of(P.words_of(t)) for _, t in items], 12)
    shard = P.Shard(*shard)
    tracemalloc.start()
    found, greatest, longest = 0, 0, 0
    for d, item, n, _ in shard.search(passages):
        found, greatest, longest = found + len(d), max(greatest, len(d)), max(longest, int(n.max()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 2000 * 5000 + 1 and greatest <= P.PAIRS and longest == 2000 and peak < 400_000_000


def test_written_arrays(spark, tmp_path):
    docs, items = sample()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    P.suffix_arrays(d).write.parquet(str(tmp_path / "arrays"))
    arrays = spark.read.parquet(str(tmp_path / "arrays"))
    assert sorted(P.search_arrays(arrays, i).collect()) == sorted(P.leaked_items(d, i).collect())
    assert P.search_arrays(arrays.limit(0), i).isEmpty() and P.search_arrays(arrays, i.limit(0)).isEmpty()


def test_matches_stay_within_documents(spark):
    passage = " ".join(f"w{i}" for i in range(14))
    docs = [(1, "w0 w1 w2 w3 w4 w5"), (2, "w6 w7 w8 w9 w10 w11 w12 w13"), (3, " ".join(f"w{i}" for i in range(11))), (4, "x " * 300_000 + passage)]
    assert [tuple(r) for r in leaks(spark, docs, [(1, passage)]).collect()] == [(4, 1, 14, 300_000)]


def test_cases(spark):
    docs, items = sample()
    assert leaks(spark, docs, [(1, None), (2, "short")]).isEmpty() and leaks(spark, [(1, None)], items).isEmpty()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("item_id", "passage", "match_words")})
    i = spark.createDataFrame(items, "item_id long, passage string").withColumn("doc_id", F.lit(1))
    found = P.leaked_items(d, i)
    hit = {r.doc_id for r in found.collect()}
    assert {r.doc_id for r in P.without_leaks(d, found).collect()} == {k for k, _ in docs} - hit
    assert P.leaked_items(d.limit(0), i).isEmpty() and P.leaked_items(d, i.limit(0)).isEmpty()
    assert P.words_of("İX ßÄ_b-c 12") == ["i̇x", "ßä", "b", "c", "12"]
