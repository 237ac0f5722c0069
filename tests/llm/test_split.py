import random
import time

import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import p3_split as P


def units(text):
    return len(text.encode("utf-16-le")) // 2


def check(text, limit, overlap):
    starts, ends = P.cut_points(text, limit, overlap)
    assert starts[0] == 0 and ends[-1] == len(text)
    kept = "".join(text[max(a, last) : b] for a, b, last in zip(starts, ends, [0, *ends[:-1]]))
    assert kept == text
    for k, (a, b) in enumerate(zip(starts, ends)):
        assert units(text[a:b]) <= limit and b > a
        if k:
            shared = units(text[a : ends[k - 1]])
            assert overlap - 1 <= shared <= overlap and a >= starts[k - 1]
            assert shared == overlap or units(text[a - 1]) == 2  # fewer only to keep a character whole
    return starts, ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence. ", "\n\n", "\n", "😀", "x" * 37, "日本語。", "```\ncode\n```\n", "\t", "é"]), min_size=1, max_size=260))
def test_pieces_give_back_the_text(parts):
    check("".join(parts), 100, 20)


def test_long_and_odd_texts():
    rng = random.Random(5)
    for text in ("x" * 50_000, "😀" * 9000, " " * 9000, "\n" * 5000, "a\n\n" * 4000, "".join(rng.choice("ab 😀\n.") for _ in range(60_000))):
        check(text, 2000, 200)
    assert P.cut_points("", 2000, 200) == ([0], [0]) and P.cut_points("x" * 2000) == ([0], [2000])
    assert len(P.cut_points("x" * 2001)[0]) == 2


def test_natural_boundaries():
    paragraph = ("A sentence of some words. " * 10).strip() + "\n\n"
    text = paragraph * 30
    _, ends = check(text, 2000, 200)
    assert all(text[:e].endswith("\n\n") for e in ends[:-1])
    words = "word " * 3000
    _, ends = check(words, 2000, 200)
    assert all(words[e - 1] == " " for e in ends)
    sizes = [b - a for a, b in zip(*P.cut_points(words, 2000, 200))]
    assert max(sizes) - min(sizes) < 100  # balanced
    code = "\n\n".join(["text " * 60, "```\n" + "line\n\n" * 200 + "```", "text " * 60] * 3)
    check(code, 2000, 200)


def test_best_of_all_ways():
    """The programme's cost is the least of all sets of cuts."""
    rng = random.Random(6)
    for _ in range(20):
        text = "".join(rng.choice(["ab ", "cd. ", "\n", "efg "]) for _ in range(14))
        limit, overlap = 24, 4
        at, penalty = P.boundaries(text, limit - overlap)
        price = dict(zip(at.tolist(), penalty.tolist()))
        total = len(text)
        if total <= limit:
            continue
        pieces = -(-(total - overlap) // (limit - overlap))
        ideal = (total + (pieces - 1) * overlap) / pieces

        def cost(cuts):
            ends = [*cuts, total]
            value = 0.0
            for k, e in enumerate(ends):
                size = e if k == 0 else e - ends[k - 1] + overlap
                if size > limit or (k == 0 and e <= overlap):
                    return None
                value += P.IMBALANCE * (size / ideal - 1) ** 2 + P.PIECE + (price[e] if e < total else 0)
            return value

        def ways(start, cuts):
            value = cost(cuts)
            if value is not None:
                yield value
            if len(cuts) < 6:
                for c in price:
                    if c > start:
                        yield from ways(c, [*cuts, c])

        _, ends = check(text, limit, overlap)
        assert abs(cost(ends[:-1]) - min(ways(0, []))) < 1e-9


def test_sections(spark):
    big = "Some words here. " * 200
    rows = [(1, [("a", 1, big, None, 3), ("b", 1, "small", None, 9999), ("c", 1, None, None, None)]), (1, [("a", 1, big, None, 3), ("b", 1, "small", None, 9999), ("c", 1, None, None, None)]), (2, None), (3, []), (4, [("d", 1, "😀" * 1001, "x", 1), ("e", 1, "😀" * 1000, "x", 1)])]
    df = spark.createDataFrame(rows, "page_id long, sections array<struct<heading:string,level:int,body:string,sha256:string,tokens:long>>")
    got = P.split_sections(df).distinct().collect()
    assert {(r.page_id, r.pos) for r in got} == {(1, 0), (4, 0)}
    pieces = sorted((r.piece, r.overlap, r.text) for r in got if r.page_id == 1)
    assert "".join(t[o:] for _, o, t in pieces) == big and [p[0] for p in pieces] == list(range(len(pieces)))
    assert P.split_sections(df.limit(0)).isEmpty()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word ", "S. ", "\n\n", "\n", "😀", "x" * 37, "日本語。", "y" * 300, "é"]), min_size=1, max_size=60), st.integers(2, 300), st.integers(0, 200))
def test_any_limit(parts, room, overlap):
    """Whatever limit and overlap are, pieces keep to them."""
    check("".join(parts), overlap + room, overlap)


def test_no_boundaries():
    for text, limit, overlap in [("x" * 400, 40, 10), ("x" * 400, 60, 20), ("x" * 300, 200, 180), ("😀" * 200, 100, 20), ("😀" * 200, 12, 10), ("x" * 300, 12, 10)]:
        check(text, limit, overlap)
    for limit, overlap in [(10, 9), (10, 10), (10, 12), (10, -1)]:
        with pytest.raises(ValueError):
            P.cut_points("x" * 400, limit, overlap)


def test_cheapest_against_all_pairs():
    """The hulls give a way as cheap as trying every boundary before each."""
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choice(["ab ", "cd. ", "\n", "\n\n", "efg ", "h" * 30, "😀"]) for _ in range(rng.randrange(40, 400)))
        limit, overlap = rng.choice([(60, 10), (100, 20), (200, 150), (47, 3)])
        sizes = [0]
        for c in text:
            sizes.append(sizes[-1] + (2 if ord(c) > 0xFFFF else 1))
        total = sizes[-1]
        if total <= limit:
            continue
        at, penalty = P.boundaries(text, limit - overlap)
        unit = [0, *(sizes[k] for k in at), total]
        penalty = [0.0, *penalty.tolist(), 0.0]
        pieces = -(-(total - overlap) // (limit - overlap))
        ideal = (total + (pieces - 1) * overlap) / pieces
        best = [0.0] + [float("inf")] * (len(unit) - 1)
        for j in range(1, len(unit)):
            ways = [best[i] + P.IMBALANCE * ((unit[j] - unit[i] + overlap) / ideal - 1) ** 2 for i in range(1, j) if unit[j] - unit[i] <= limit - overlap]
            if overlap < unit[j] <= limit:
                ways.append(P.IMBALANCE * (unit[j] / ideal - 1) ** 2)
            best[j] = min(ways, default=float("inf")) + penalty[j] + P.PIECE
        before = P._cheapest(unit, penalty, limit, overlap, ideal)
        cost, j = 0.0, len(unit) - 1
        while j:
            i = before[j]
            size = unit[j] if i == 0 else unit[j] - unit[i] + overlap
            cost += P.IMBALANCE * (size / ideal - 1) ** 2 + penalty[j] + P.PIECE
            j = i
        assert abs(cost - best[-1]) < 1e-6


def test_many_boundaries():
    began = time.monotonic()
    check("short line\n" * 200_000, 2000, 200)
    assert time.monotonic() - began < 10


def test_rebuilt(spark):
    bodies = ["Some words here. " * 200, "😀" * 1500, "日本語。" * 700]
    df = spark.createDataFrame([(i, [("a", 1, b, None, 3)]) for i, b in enumerate(bodies)] * 2, "page_id long, sections array<struct<heading:string,level:int,body:string,sha256:string,tokens:long>>")
    got = P.rebuilt(P.split_sections(df)).collect()
    assert {(r.page_id, r.body) for r in got} == set(enumerate(bodies)) and len(got) == 3 and all(r.within and r.pieces > 1 for r in got)
