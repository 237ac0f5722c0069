import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import p1_lines as P

SCHEMA = "page_id long, url string, markdown string"


def form(line):
    return " ".join(re.findall(r"[^\W_]+", re.sub(r"[0-9]+", "0", line.lower())))


def brute(rows):
    pages = {p: (u, m) for p, u, m in rows}
    site = {p: (re.sub(r"^www\.", "", re.match(r"\w+://([^/:?#]*)", u.lower()).group(1)) if u and "://" in u else "unknown") for p, (u, _) in pages.items()}
    on = defaultdict(set)
    lines = {}
    for p, (_, m) in pages.items():
        for n, line in enumerate((m or "").split("\n")):
            if m is not None and not line.lstrip().startswith("#") and len(form(line)) >= 20:
                on[site[p], form(line)].add(p)
                lines[p, n] = (site[p], form(line))
    size = Counter(site.values())
    return {k for k, f in lines.items() if len(on[f]) >= 6 and 20 * len(on[f]) >= size[f[0]]}


def sample(n=400):
    rng = random.Random(1)
    notice = ["Share this page with all of your friends {}", "# Share this page with all of your friends", "too short {}", "All rights are reserved {} by the press of the site", "ÄÖÜ größere Hinweise {} auf jeder Seite"]
    rows = []
    for i in range(n):
        host = "https://www.Hot.example:80/" if i % 3 == 0 else f"http://s{i % 17}.example/x"
        body = [rng.choice(notice).format(rng.randint(1, 99)) for _ in range(rng.randint(0, 3))] + [f"content of page {i} number {rng.random()} and more"]
        rng.shuffle(body)
        rows.append((i, host, "\n".join(body)))
    return rows


def found(spark, rows):
    return {tuple(r) for r in P.frequent_lines(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_against_brute_force(spark):
    rows = sample()
    expected = brute(rows)
    assert expected and found(spark, rows) == expected
    assert found(spark, rows + rows[:150]) == expected  # redelivered rows count once


def test_cases(spark):
    line = "the very same line on every single page"
    rows = [(i, None if i % 2 else "no address", f"{line}\n\n{i}") for i in range(6)]
    assert found(spark, rows) == {(i, 0) for i in range(6)}  # all of the site `unknown`
    assert found(spark, rows[:5]) == set() and found(spark, [(1, None, None), (2, None, "")]) == set()
    df = spark.createDataFrame(rows, SCHEMA)
    assert P.frequent_lines(df.limit(0)).isEmpty()
    clash = df.withColumns({c: F.lit("x") for c in ("id", "h", "site", "line", "n", "line_no", "form")})
    assert P.frequent_lines(clash).count() == 6
    long = spark.createDataFrame([(i, "http://a.b/", "\n".join([line, "w " * 200_000, line])) for i in range(6)], SCHEMA)
    assert {r.line_no for r in P.frequent_lines(long).collect()} == {0, 1, 2}


def test_rebuilt(spark):
    rows = sample(120) + [(900, None, None), (901, None, "")]
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    got = {r.page_id: (r.markdown, r.removed) for r in P.without_lines(df, P.frequent_lines(df)).collect()}
    gone = brute(rows)
    for p, _, m in rows:
        kept = None if m is None else "\n".join(x for n, x in enumerate(m.split("\n")) if (p, n) not in gone)
        assert got[p] == (kept, sum(k[0] == p for k in gone))
    assert len(got) == len(rows)


def test_site(spark):
    df = spark.createDataFrame([("HTTP://u@www.A.b:1/c",), ("x",), (None,), ("https://[::1]:3/",)], "u string")
    assert [r[0] for r in df.select(P.site_of(F.col("u"))).collect()] == ["a.b", "unknown", "unknown", "[::1]"]
