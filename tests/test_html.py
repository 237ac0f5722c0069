from pyspark.sql import functions as F

from tidemark.functions import html
from tidemark.functions.html import clean_href, to_markdown

LONG = "word " * 120


def test_content_choice():
    page = f"<body><nav>menu</nav><div class='content'>{LONG} side</div><main><h2>Real</h2>{LONG}</main><footer>f</footer></body>"
    assert to_markdown(page).startswith("## Real") and "menu" not in to_markdown(page)
    short = "<body><main>tiny</main><div><p>" + "A long paragraph, with commas, and text. " * 5 + "</p></div></body>"
    assert "long paragraph" in to_markdown(short)
    assert to_markdown("") == "" and to_markdown(None) is None and to_markdown("<p>only</p>") == "only"


def test_noise():
    for noise in ("<div class='x ad y'>gone</div>", "<div id='my-cookie-bar'>gone</div>", "<p hidden>gone</p>", "<div aria-hidden='true'>gone</div>", "<div data-ad>gone</div>", "<aside>gone</aside>"):
        assert "gone" not in to_markdown(f"<article>{LONG}{noise}</article>")
    assert "kept" in to_markdown(f"<article>{LONG}<p class='adult'>kept</p></article>")


def test_markdown():
    page = f"""<article><h1>T <a href="#a"></a></h1><p>{LONG}</p><p>Hello <b>bold</b> <em>it</em> <code>a`b</code><p>two<ul><li>one<ul><li>in</ul><li>two</ul>
    <ol start=3><li>a<li>b</ol><pre class="language-py"><code>x = 1\n\n  y</code></pre><table><tr><th>A<th align=right>B<tr><td>1|2<td>3</table><blockquote>q</blockquote><img src="a.png" alt="pic"><img src="data:x" alt="d"><hr><s>g</s> 1 * 2 [z]</article>"""
    got = to_markdown(page)
    for part in ("# T\n", "Hello **bold** _it_ ``a`b``", "-   one\n    -   in\n-   two", "3.  a\n4.  b", "```py\nx = 1\n\n  y\n```", "| A | B |\n| --- | --: |\n| 1\\|2 | 3 |", "> q", "![pic](a.png)", "---", "~g~ 1 \\* 2 \\[z\\]"):
        assert part in got, part
    assert "data:" not in got


def test_links():
    assert clean_href("https://Ex.com/p?utm_source=a&ref=b&k=1#f") == "https://ex.com/p?k=1#f"
    assert [clean_href(h) for h in ("#x", "", "javascript:x", "MAILTO:a@b", "/rel?ref=1")] == ["", "", "", "", "/rel?ref=1"]
    assert to_markdown("<p><a href='https://a.b/'>https://a.b/</a> <a href='/x'></a><a href='#y'>here</a></p>") == "https://a.b/ here"


def test_pretrim_and_tidy(spark):
    raw = "<!-- a\nb --><SCRIPT>x</SCRIPT><p style='a\"b'>k</p><img src=\"data:x\"><svg>\n</svg><template>t</template><noscript>n</noscript>"
    df = spark.createDataFrame([(raw,), (None,)], "h string")
    assert [r[0] for r in df.select(html.pretrim("h")).collect()] == ["<p style='a\"b'>k</p><img src=\"\">", None]
    df = spark.createDataFrame([("a  \n\n\n\nb [](x) c\t\n",)], "m string")
    assert df.select(html.tidied(F.col("m"))).first()[0] == "a\n\nb c"
    df = spark.createDataFrame([(f"<main><h1>A</h1><p>{LONG}</p></main>",), (None,), ("",)], "h string")
    got = [r[0] for r in df.select(html.distill_html("h")).collect()]
    assert got[0].startswith("# A\n\nword") and got[1:] == [None, ""]


def test_shells(spark):
    df = spark.createDataFrame([("<div id=\"root\"></div>", 2000, 10), ("<p>", 2000, 10), ("<p>", 4000, 10), ("<div id='app'>", 900, 1), ("<div id='app'>", 2000, 200), (None, None, None)], "h string, o long, d long")
    assert [r[0] for r in df.select(html.looks_unrendered(F.col("h"), F.col("o"), F.col("d"))).collect()] == [True, False, True, False, False, False]
    df = spark.createDataFrame([("x", 10, True, "x" * 40, 30), ("x", 10, True, None, None), ("x", 10, False, "x" * 40, 30)], "m string, o long, s boolean, r string, t long")
    got = [tuple(r[0]) for r in df.select(html.with_rendered(*(F.col(c) for c in "mosrt"))).collect()]
    assert got == [("x" * 40, 30, True, False), ("x", 10, False, True), ("x", 10, False, False)]
