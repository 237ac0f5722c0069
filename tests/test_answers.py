from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.operators import answers

OLD = "intro\n## A\none\n## B\ntwo\n## Gone\nx"
NEW = "intro\n## A\none\n## B\ntwo, edited\n## C\nnew"


def test_fetch_view(spark):
    saves = spark.createDataFrame([("https://ex.com/p", OLD), ("https://ex.com/p", OLD), ("https://ex.com/p", NEW), ("https://ex.com/p", None)], "url string, markdown string").withColumn("url_hash", urls.url_hash("url"))
    pages = spark.createDataFrame([("https://ex.com/p", NEW, 100)], "url string, markdown string, original_tokens long").withColumn("url_hash", urls.url_hash("url"))
    old, new = (spark.createDataFrame([(x,)], "t string").select(text.content_hash("t")).first()[0] for x in (OLD, NEW))
    at = "https://www.ex.com/p/?utm_source=q"
    requests = [(1, at, None, None, None), (2, at, new, None, None), (3, at, old, None, None), (4, at, old, "b", None), (5, at, "junk", "nothing", None), (6, at, None, None, 3), (7, "https://other.org/", None, None, None), (8, None, None, None, None), (9, at, old, "", 0)]
    df = spark.createDataFrame(requests, "request_id long, url string, known_hash string, section string, token_budget int")
    got = {r.request_id: r for r in answers.fetch_view(df, pages, saves).collect()}
    delta = "## B\ntwo, edited\n\n## C\nnew\n\n_Removed since then: Gone_"
    assert {k: (r.state, r.markdown) for k, r in got.items()} == {
        1: ("page", NEW), 2: ("unchanged", None), 3: ("delta", delta), 4: ("section", "## B\ntwo, edited"), 5: ("page", NEW),
        6: ("page", "intro\n## A\no\n\n_[clipped to ~3 tokens]_"), 7: ("missing", None), 8: ("missing", None), 9: ("delta", delta),
    }
    assert (got[3].sections_changed, got[3].sections_total) == (2, 4) and got[2].saved == got[2].tokens == -(-len(NEW) // 4) and got[1].saved == 100 + (-len(NEW) // 4)
    assert answers.fetch_view(df.limit(0), pages, saves).isEmpty()
    assert answers.fetch_view(df, pages.limit(0), saves.limit(0)).filter(F.col("state") != "missing").isEmpty()
