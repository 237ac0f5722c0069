import pytest
from pyspark.sql import functions as F

from tidemark.llm import p2_residue as P

SCHEMA = "page_id long, url string, markdown string"
REAL = "# Keys\n\nThe cache keeps a key for each page and drops it when the page is older than its window."


@pytest.mark.parametrize(
    "text",
    ["Dear {{ user.name }}, hello", "See ${a.b} now", "Welcome {% block x %}", "Hi <%= a.b %>", "%%NAME_HERE%%", "@@name@@", "__FULL_NAME__", "by [INSERT NAME HERE].", "[Your title goes here]", "&lt;name placeholder&gt;", "<owner name>", "got [object Object],", "See {0} of {1}", "undefined undefined said", "NaN days ago", "TODO: add text"],
)
def test_placeholders(text):
    assert P.has_placeholder(P.outside_code(text))
    assert not P.has_placeholder(P.outside_code(f"A `{text}` in code, and\n```\n{text}\n```\n"))


@pytest.mark.parametrize("text", ["[Improve this text](https://a.b/c)", "a {} b", "50% of 20%", "__init__ and __bold__", "x < y and y > z", "<https://a.b>", "the value undefined is a word", "the TODO list", "[1] and [note]", "", "f(x) = {x | x > 1}"])
def test_plain_texts(text):
    assert not P.has_placeholder(P.outside_code(text))


def test_filler():
    assert P.has_filler("Lorem ipsum dolor sit amet consectetur adipiscing elit sed.") and P.has_filler("This is sample text for X. Replace it with your own words.")
    assert P.has_filler("real words first\n- Dolor amet sit lorem ipsum magna aliqua nisi.")
    assert P.has_filler("Nimgorin a-b-c " + "asdf " * 8) and P.has_filler("Text text TEXT text text text text") and P.has_filler("テキスト" * 9) and not P.has_filler("very very very good, said he he he")
    assert not P.has_filler("The word lorem in a page is the name of a registry, not filler. It's safe to store it.") and not P.has_filler("")


RESPONSES = [
    "Fehler 404: Die Seite wurde nicht gefunden",
    "404 Not Found",
    "Erreur 500 : la page x est introuvable",
    "Please enable JavaScript to view this page",
    "You need JavaScript turned on",
    "Bitte aktivieren Sie JavaScript",
    "No se pudo abrir la página: el servidor respondió 404.",
    "申し訳ありません。ページは見つかりませんでした",
    "x を表示するには JavaScript を有効にしてください",
    "Access denied. You lack the rights to open this.",
    "Too many requests. Try again in 5 minutes.",
    "Traceback (most recent call last):",
    "KeyError: x",
    "The site is down for maintenance",
]


@pytest.mark.parametrize("line", RESPONSES)
def test_response_lines(line):
    assert P.is_response_line(line)


@pytest.mark.parametrize("line", ["Readers without JavaScript get the static page of x", "The limit of 404 entries applies to pages", "A page without a header can't be stored", "480. `x`: we measured 5 hops", ""])
def test_other_lines(line):
    assert not P.is_response_line(line)


def reasons(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.page_id: r.reason for r in P.residue_pages(df).collect()}


def test_pages(spark):
    share = "Tell your group about this page: mail and print, {} times"
    rows = [(i, f"https://a.example/p{i}", f"{share.format(i)}\n\n{REAL} {i}") for i in range(8)]
    rows += [(100 + i, "https://a.example/q", f"{share.format(i)}\n\n{x}") for i, x in enumerate(RESPONSES)]
    rows += [(200, "https://b.example/", REAL + "\n\nIf you see 404 Not Found, the page was moved, which the cache notices after a while."), (201, None, "{{x}}"), (202, None, None), (203, None, ""), (204, None, "# 404"), (205, None, "word"), (206, None, "# 404 Not Found\n\nGo home"), (207, None, f"# Error 500 explained\n\n{REAL}")]
    got = reasons(spark, rows + rows[-6:])
    assert got == {100 + i: "response" for i in range(len(RESPONSES))} | {201: "placeholder", 206: "response"}


def test_duplicated_skeletons(spark):
    """A message in no known words is told by its skeleton on several hosts; the same paragraph copied to several hosts isn't one."""
    strange = [(i, f"https://h{i}.example/x/{i}", f"# Title{i}\n\nZorg mumble {name} frob quux while {name.lower()}-xyz-{i}") for i, name in enumerate(["Alpha", "Beta", "Gamma", "Delta"])]
    prose = [(20 + i, f"https://g{i}.example/", f"# Titel\n\nFür {a} gilt: ohne {b} bleibt das Paket von {a} unverändert") for i, (a, b) in enumerate([("Alpha", "Beta"), ("Gamma", "Delta"), ("Eta", "Theta"), ("Iota", "Kappa")])]
    copied = [(10 + i, f"https://k{i}.example/", "# Same\n\nsome ordinary paragraph that stands here and also on other hosts") for i in range(4)]
    assert reasons(spark, strange + copied + prose) == {i: "response" for i in range(4)}


def test_message_of_many_pages(spark):
    """A host may answer a large part of its addresses with one fixed text; under its pages with content the same text is only a notice."""
    notice = "Please enable JavaScript to view this page"
    rows = [(i, f"https://a.example/r{i}", f"# Title {i}\n\n{notice}\n\n{REAL.splitlines()[2]} Thus {'abcdefghijklmnopqrst'[i]} holds.") for i in range(20)]
    rows += [(100 + i, f"https://a.example/p{i}", f"# Title {i}\n\n{notice}") for i in range(10)]
    assert reasons(spark, rows) == {100 + i: "response" for i in range(10)}


def test_redelivered_pages(spark):
    """Other words count once however often a page is delivered; a page's equal lines all count."""
    rows = [(1, "https://a.example/1", "404 Not Found\n\nGo back to the start page of it"), (2, "https://b.example/1", "404 Not Found\n\nGo back to the start page\n\nGo back to the start page")]
    assert reasons(spark, rows) == reasons(spark, rows + rows[:1] * 3) == {1: "response"}


def test_long_repeated_lines(spark):
    """On a site with much repeated text a message stands between more of it than a short page has."""
    menu = "\n\n".join(f"Our {w} offers what readers of {w} pages look for, and more about it in the yearly {w} report" for w in (a + b for a in "abcde" for b in "fghij"))
    assert len(menu) > 1500
    own = [f"{REAL.splitlines()[2]} Thus {'abcdefghijklmnopqrst'[i]} holds." for i in range(20)]
    rows = [(i, f"https://a.example/r{i}", f"# Title {i}\n\n{menu}\n\n{own[i]}") for i in range(20)]
    rows += [(100, "https://a.example/x", f"{menu}\n\nThe page nimgorin could not be found"), (101, "https://a.example/y", f"{menu}\n\nThe page nimgorin could not be found\n\n{own[0]} {own[1]}")]
    rows += [(102, "https://b.example/y", f"{menu}\n\nThe page nimgorin could not be found")]
    assert reasons(spark, rows + rows[-3:]) == {100: "response"}


def test_clean(spark):
    df = spark.createDataFrame([(1, "u", "{{x}}"), (2, "u", REAL), (2, "u", REAL), (3, None, None)], SCHEMA)
    assert sorted(r.page_id for r in P.without_residue(df, P.residue_pages(df)).collect()) == [2, 3]
    assert P.residue_pages(df.limit(0)).isEmpty()
    clash = df.withColumns({c: F.lit("x") for c in ("id", "text", "h", "sk", "kind", "line", "hit")})
    assert [r.page_id for r in P.residue_pages(clash).collect()] == [1]


def test_long_text(spark):
    assert reasons(spark, [(1, "u", "word " * 300_000 + "{{ x }}"), (2, "u", "`" * 9999 + "word " * 100_000)]) == {1: "placeholder"}


def test_any_language(spark):
    """Lone messages in languages and words that no table of this project holds."""
    probes = [
        "La pagina richiesta non è stata trovata sul server.", "Página não encontrada.", "К сожалению, страница не найдена.", "Чтобы просматривать этот сайт, включите JavaScript.", "抱歉，您访问的页面不存在。", "请启用 JavaScript 以继续。",
        "Sorry, we couldn't find what you were after.", "You are not authorised to see this.", "Deze pagina bestaat niet meer.", "Nie znaleziono strony.", "페이지를 찾을 수 없습니다.", "Sayfa bulunamadı", "Sidan kunde inte hittas.", "الصفحة غير موجودة",
    ]
    real = [
        "The set {1} has one element and {2} has one too.", "If you've moved the page, the cache still keeps its empty copy for a while and drops it later than the others.", "Das Paket prüft den Auszug nach 512 Sekunden erneut.",
        "Use f(x) = {x | x > 1} and \\frac{abc}{def} here.", "La caché garde chaque page une heure.", "キャッシュはページを一時間保存します。",
    ]
    rows = [(i, f"https://h{i}.example/a", f"# Word{i}\n\n{x}") for i, x in enumerate(probes)] + [(100 + i, f"https://k{i}.example/a", x) for i, x in enumerate(real)]
    rows += [(200, "https://z.example/", "Dear {name}, thank you for the order."), (201, "https://z.example/2", "Buy <PRODUCT_NAME> now and save"), (202, "https://z.example/3", "# Price\n\nundefined\n\nA real line of text about the price of keys.")]
    assert reasons(spark, rows) == {i: "response" for i in range(len(probes))} | {i: "placeholder" for i in (200, 201, 202)}


def test_any_length(spark):
    """A message counts whatever the length of what the host repeats, a lone page's own text is never cut."""
    menu = "\n\n".join(f"Section {a}{b} of the yearly report for readers and writers of this place" for a in "abcdefghij" for b in "klmnopqrst")
    own = [f"{REAL.splitlines()[2]} Thus {'abcdefghijklmnopqrst'[i]} holds." for i in range(20)]
    rows = [(i, f"https://a.example/r{i}", f"# Title {i}\n\n{menu}\n\n{own[i]}") for i in range(20)] + [(100, "https://a.example/x", f"404 - Page not found. The page does not exist.\n\n{menu}")]
    rows += [(101, "https://b.example/x", "404 - Page not found.\n\n" + "some real words " * 5000)]
    assert reasons(spark, rows) == {100: "response"}


def test_partial_hint(spark):
    """A page that the crawler took for an unrendered one may have some more words besides the message."""
    text = "Please enable JavaScript to view this page\n\nNimgorin corist epheth wex olar tand brui keel marr osto dunn filt"
    df = spark.createDataFrame([(1, "https://a.example/", text, True), (2, "https://b.example/", text, None), (3, "https://c.example/", REAL, True)], SCHEMA + ", spa_partial boolean")
    assert [tuple(r) for r in P.residue_pages(df).collect()] == [(1, "response")]
