from tidemark.functions import addresses, urls
from tidemark.operators.demand import feed_of


def values(spark, f, inputs):
    df = spark.createDataFrame([(v,) for v in inputs], "url string")
    return [r[0] for r in df.select(f("url")).collect()]


def test_canonical(spark):
    wanted = {
        "HTTP://WWW.Harbour.net:80/Tide/Tables/?_ga=1.2&moon=full&MSCLKID=z": ("http://harbour.net/Tide/Tables?moon=full", "normalized"),
        "https://harbour.net/tide?moon=full": ("https://harbour.net/tide?moon=full", "raw"),
        "https://mirror.harbour.net/abs/2101.00001": ("https://mirror.harbour.net/abs/2101.00001", "raw"),
        "https://ar5iv.labs.arxiv.org/abs/2101.00001?yclid=4": ("https://ar5iv.org/abs/2101.00001", "mirror"),
        "mailto:pilot@harbour.net": ("mailto:pilot@harbour.net", "raw"),
        "harbour, east pier": ("harbour, east pier", "raw"),
        None: (None, "raw"),
        "https://harbour.net/?ref_src=a#low": ("https://harbour.net/", "normalized"),
        "https://harbour.net": ("https://harbour.net/", "normalized"),
    }
    assert [tuple(r) for r in values(spark, urls.canonical, list(wanted))] == list(wanted.values())


def test_keys(spark):
    a, b, c, d = values(spark, urls.url_hash, ["https://ex.com/docs", " https://ex.com/docs/#top", "https://www.ex.com/docs", None])
    assert a == b and a != c and len(a) == 32 and d is None
    assert values(spark, urls.site, ["https://www.Ex.com/x", "nope", None, "http://[::1]:8080/"]) == ["ex.com", "unknown", "unknown", "[::1]"]
    assert values(spark, urls.doc_set, ["https://react.dev/learn/x", "https://react.dev", "//x", None]) == ["react.dev/learn", "react.dev", "unknown", "unknown"]
    note = values(spark, urls.target_key, ["npm:Next  JS!", "HTTPS://ex.com/docs/", "x" * 100])
    assert note == ["t:npm-next-js", f"u:{a}", "t:" + "x" * 80]


def test_client(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", None), (None, "s1"), ("", None)], "f string, s string")
    assert [r[0] for r in df.select(urls.client_key("f", "s")).collect()] == ["1.2.3.4", "s:s1", "anon"]


def test_refusals(spark):
    got = values(
        spark,
        addresses.refusal,
        ["http://169.254.169.254/latest/meta-data/", "http://localhost:3000/", "http://127.0.0.1/", "http://[::1]/", "http://[::ffff:7f00:1]/", "http://[::ffff:10.0.0.1]/", "http://a.internal/", "ftp://x.org/", "x", None, "https://8.8.8.8/", "https://ex.com/"],
    )
    assert got == ["private", "internal", "private", "private", "private", "private", "internal", "scheme", "invalid", "invalid", None, None]
    edges = ["9.255.255.255", "10.0.0.0", "172.15.255.255", "172.31.255.255", "172.32.0.0", "100.64.0.0", "100.128.0.0", "198.19.255.255", "223.255.255.255", "224.0.0.0", "fe7f::1", "fe80::1", "fd00::", None, "999.1.1.1"]
    assert values(spark, addresses.is_private, edges) == [False, True, False, True, False, True, False, True, False, True, False, True, True, False, False]


def test_responses(spark):
    assert values(spark, addresses.is_text_type, [None, "Text/HTML; charset=x", "image/png", "application/xhtml+xml"]) == [True, True, False, True]


def test_feeds(spark):
    got = values(spark, feed_of, ["https://react.dev/learn", "https://github.com/a/b/c", "https://github.com/a", "https://www.npmjs.com/package/@x/y", "https://pypi.org/project/z/", "https://blog.org/", None])
    assert [r and (r["type"], r["id"]) for r in got] == [("npm", "react"), ("github", "a/b"), None, ("npm", "@x/y"), ("pypi", "z"), None, None]
