"""Template residue and error-page text.

A page is excluded if its text outside code shows an unfilled placeholder or a printed empty value, if a paragraph is
filler, or if it consists of an error message, an access refusal or a demand for scripts.

The last kind is judged by combined evidence on what is left of a page without the lines that its host repeats
excessively, however long the page is. On pages of little information, lines that look like what any host repeats say nothing
about the page either. Of the rest, a line is a response line if a sentence of it has the meaning of a message in some language (`message_terms`), or if
its skeleton, with names, numbers and terms of the address masked, is duplicated over hosts, or over much of one host,
around different names while it names a slug and shares no term with the page's title and address. A page is a response if
it has such a line and next to nothing else; of a page that its crawler took for an unrendered one, a little more may be left.
Evidence of skeletons alone counts for pages of little information only.

Null and empty texts are no cases. Rows with one id count once.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.message_terms import MessageFinder
from tidemark.llm.p1_lines import MIN_FORM, MIN_PAGES, MIN_SHARE_PERCENT, exploded_lines, frequent_hashes, limited, line_form, site_of
from tidemark.sources.scratch import Scratch

#: Words besides response lines that a response may have; twice as many if the page was taken for an unrendered one.
OTHER_WORDS = 10
#: Words after the message in its own line, an explanation, that don't count among the others.
EXPLANATION_WORDS = 30
#: Words without what its host repeats, up to which a page has so little information that its likeness to other hosts' pages counts: a
#: duplicated skeleton can make it a response, and lines like those that other hosts repeat are none of its own.
LITTLE_WORDS = 150
#: Pages of its host on which a line of such a page must stand to be none of its own, where the host is too small for it to be excessive.
AGAIN = 3
#: Hosts on which a skeleton must stand to count as a duplicated response.
HOSTS = 3
#: Words up to which a line carries little enough for its skeleton to count.
LINE_WORDS = 30
#: Words that a skeleton must hold besides masked ones.
PLAIN_WORDS = 3

# Marks of placeholders in common template languages, and values printed where one is missing.
PLACEHOLDERS = [
    r"\{\{[^{}\n]{1,80}\}\}",
    r"\{%[^%\n]{1,80}%\}",
    r"[$#]\{[^{}\n]{1,80}\}",
    r"\{\$[A-Za-z_]\w*\}",
    r"(?<![\w\\^_$={}/@:])\{[A-Za-z_][A-Za-z0-9_]{2,40}(?:\.[A-Za-z_]\w*)*\}(?![\w{}/])",
    r"<%=?[^%\n]{1,80}%>",
    r"%%[A-Z][A-Z0-9_]*%%",
    r"(?<!\w)%[A-Z][A-Z0-9]*_[A-Z0-9_]*%(?!\w)",
    r"@@[A-Za-z_]\w*@@",
    r"(?<!\w)__[A-Z][A-Z0-9_]*__(?!\w)",
    r"\[\[[A-Za-z_][\w .-]*\]\]",
    r"\[(?i:insert|enter|replace|add|your|put|type)\b[^\]\n]{0,60}(?i:here|text|name|title)\](?!\()",
    r"(?:<|&lt;)[a-z]+(?:[ _-](?:name|placeholder|title|here|value|text|date|author))(?:>|&gt;)",
    r"<[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+>|<(?:NAME|TITLE|DATE|EMAIL|CITY|COMPANY|PRODUCT|USERNAME|YEAR|AUTHOR)>",
    r"\[object [A-Z]\w*\]",
    r"(?m)^\W*(?:undefined|null|NaN)\W*$",
    r"\bundefined undefined\b|\bnull null\b|\bNone None\b",
    r"\bNaN(?: [a-z]+){1,2} ago\b|\bNaN[/:%]|\$NaN\b|\bInvalid Date\b",
    r"\bTODO: ?(?:add|write|insert|fill|replace)\b|\bTKTK\b",
]
# The words of the usual filler text.
FILLER_WORDS = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna
    aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
    reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
    officia deserunt mollit anim id est laborum""".split()
)
# Sentences that announce filler.
FILLER = [
    r"\b(?:sample|placeholder|dummy|filler|example) (?:text|copy|content)\b.{0,120}\b(?:replace|your own|goes here|before you publish)\b",
    r"\b(?:Blindtext|Platzhaltertext|Beispieltext)\b.{0,120}\b(?:ersetzen|eigenen|ersetze)\b",
    r"\btexte (?:d'exemple|factice|de remplissage)\b.{0,120}\b(?:remplace|votre propre|vos propres)",
    r"\btexto (?:de ejemplo|de relleno|ficticio|de muestra)\b.{0,120}\b(?:reempl|sustit|su propio)",
    r"(?:ダミーテキスト|サンプルテキスト|仮のテキスト)",
]
FENCE = re.compile(r"^[ \t>]*(```+|~~~+)[^\n]*(?:\n.*?(?:^[ \t>]*\1[^\n]*$|\Z)|\Z)", re.S | re.M)
INLINE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
#: For each pattern strings of which a match holds at least one; a text without them needn't be searched.
_HELD = ["{{", "{%", ("${", "#{"), "{$", "{", "<%", "%%", "%", "@@", "__", "[[", "[", ("<", "&lt;"), "<", "[object ", ("undefined", "null", "NaN"), ("undefined u", "null n", "None N"), ("NaN", "Invalid D"), ("TODO:", "TKTK")]
_PLACEHOLDERS = [(held if isinstance(held, tuple) else (held,), re.compile(pattern)) for held, pattern in zip(_HELD, PLACEHOLDERS, strict=True)]
#: Numbered placeholders count from 0; numbers in braces without it are sets.
_NUMBERED = re.compile(r"\{0\}.*?\{1\}|(?<![\w\\^_={}])\{0\}(?![\w{}])", re.S)
_FILLERS = [
    (held, re.compile(pattern, re.I | re.S))
    for held, pattern in zip([("sample ", "placeholder ", "dummy ", "filler ", "example "), ("blindtext", "platzhaltertext", "beispieltext"), ("texte ",), ("texto ",), ("テキスト",)], FILLER, strict=True)
]
_WORD = re.compile(r"[^\W\d_]+")
#: One word, or in scripts without blanks a few characters, over and over.
_SAME_WORD = re.compile(r" ([^\W\d_]{2,30}+)(?: \1){5}(?!\w)")
_KANA = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]{16}")
_SAME_KANA = re.compile(r"([\u3040-\u30ff\u4e00-\u9fff]{1,6}?)\1{7}")


def outside_code(text: str) -> str:
    """The text without fenced blocks and code spans."""
    return INLINE.sub(" ", FENCE.sub("\n", text)) if "`" in text or "~~~" in text else text


def has_placeholder(prose: str) -> bool:
    return ("{0}" in prose and _NUMBERED.search(prose) is not None) or any(pattern.search(prose) for held, pattern in _PLACEHOLDERS if any(h in prose for h in held))


def has_filler(prose: str) -> bool:
    """A paragraph of at least 8 words, more than half of them filler; one word six times in a row; or a paragraph that announces itself as filler."""
    low = prose.lower()
    if ("dolor" in low or "ipsum" in low or "lorem" in low or "eiusmod" in low) and any(_is_filler(p) for p in (*re.split(r"\n\s*\n", low), *low.split("\n"))):
        return True
    words = low.split()
    if (any(map(operator.eq, words, words[1:])) and _SAME_WORD.search(f" {' '.join(words)}")) or (_KANA.search(low) and _SAME_KANA.search(low)):
        return True
    return any(pattern.search(prose) for held, pattern in _FILLERS if any(h in low for h in held))


def _is_filler(paragraph: str) -> bool:
    words = _WORD.findall(paragraph)
    return len(words) >= 8 and 2 * sum(w in FILLER_WORDS for w in words) > len(words)


_WORDS = re.compile(r"[^\W_]+")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")


def word_count(text: str) -> int:
    """Runs of letters and digits; scripts without blanks count a word for two characters besides."""
    return len(_WORDS.findall(text)) + (0 if text.isascii() else len(_DENSE.findall(text)) // 2)


def is_response_line(line: str) -> bool:
    return any(True for _ in MessageFinder().lines(line))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page its own verdict, or else its lines that hold a message, with the words before the message and those after it that exceed an explanation."""
    finder = MessageFinder()
    for batch in batches:
        ids, kinds, numbers, lines, rests = [], [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            prose = outside_code(text)
            kind = "placeholder" if has_placeholder(prose) else "filler" if has_filler(prose) else None
            if kind:
                for column, value in zip((ids, kinds, numbers, lines, rests), (key, kind, None, None, 0)):
                    column.append(value)
                continue
            for line_no, line, before, after in finder.lines(text):
                over = sum(map(word_count, before)) + max(0, sum(map(word_count, after)) - EXPLANATION_WORDS)
                for column, value in zip((ids, kinds, numbers, lines, rests), (key, "message", line_no, line, over)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string()), pa.array(rests, pa.int64())], ["id", "kind", "line_no", "line", "rest"])


#: Marks in skeletons: small letters that don't occur by themselves.
SLUG, NAME = "\u017f", "\u014b"


def skeleton(line):
    """The line with slugs, names and numbers masked, in lower case, its runs of letters and digits joined by one blank."""
    masked = F.regexp_replace(line, r"[\p{L}\p{N}]+(?:[-_][\p{L}\p{N}]+)+", f" {SLUG} ")
    masked = F.regexp_replace(masked, r"[0-9]+", " 0 ")
    masked = F.regexp_replace(masked, r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{N}]*", f" {NAME} ")
    return F.trim(F.regexp_replace(F.lower(masked), r"[^\p{L}\p{N}]+", " "))


def _words(line: Column, form: Column) -> Column:
    """word_count in Catalyst."""
    dense = F.floor(F.length(F.regexp_replace(line, r"[^\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{0e00}-\x{0e7f}]", "")) / 2)
    runs = F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) + 1
    return F.when(form == "", 0).otherwise(runs) + F.when(F.octet_length(line) > F.length(line), dense).otherwise(0)


def _body_lines(source: DataFrame) -> DataFrame:
    """(id, site, line_no, line, form, h) of the lines that aren't headings and have a letter or digit; h is null for forms too short to count as repeated."""
    at = exploded_lines(source, "text", "id", site_of(F.col("url")).alias("site"))
    return at.withColumn("h", F.when(F.length("form") >= MIN_FORM, F.xxhash64("site", "form")))


def residue_pages(pages: DataFrame, id_col: str = "page_id", text_col: str = "markdown", url_col: str = "url", partial_col: str | None = "spa_partial") -> DataFrame:
    """(id_col, reason) of the pages to leave out; reason is `placeholder`, `filler` or `response`, one row a page.

    partial_col is the crawler's hint that a page is an unrendered one; None, or a table without that column, gives no hint.
    """
    scratch = Scratch(pages.sparkSession, "p2")
    hint = F.coalesce(F.col(partial_col), F.lit(False)) if partial_col in pages.columns else F.lit(False)
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("text"), hint.alias("partial")).filter("id is not null")
    screened = scratch.keep(source.select("id", "text").mapInArrow(_screen, "id long, kind string, line_no long, line string, rest long"), "screened")
    own = screened.filter("kind != 'message'").groupBy("id").agg(F.max("kind").alias("reason"))

    body = _body_lines(source)
    lines = scratch.keep(body.select("id", F.xxhash64("site").alias("site_key"), "line_no", "h", _words(F.col("line"), F.col("form")).cast("int").alias("words")), "lines")
    hot = scratch.keep(frequent_hashes(lines.filter("h is not null"), source, "id", "url", MIN_PAGES, MIN_SHARE_PERCENT).select("h"), "hot")
    hot = limited(hot)
    # words of a page's own; a page delivered again gives the same lines again
    single = lines.join(hot, "h", "left_anti").groupBy("id", "line_no").agg(F.max("words").alias("words")).groupBy("id").agg(F.sum("words").alias("words"))
    sites = source.groupBy("id").agg(F.max(site_of(F.col("url"))).alias("site"), F.max("partial").alias("partial"))
    pages_ = sites.join(single, "id", "left").select("id", "site", "partial", F.coalesce("words", F.lit(0)).alias("words"))
    found = screened.filter("kind = 'message'").dropDuplicates(["id", "line_no"])
    counted = pages_.join(found.select("id", "line_no", "line", "rest"), "id", "left").withColumn("form", line_form(F.col("line")))
    heads = F.col("line").rlike(r"(?U)^\s*#")
    counted = counted.withColumn("h", F.when((F.length("form") >= MIN_FORM) & ~heads, F.xxhash64("site", "form"))).join(hot.withColumn("excessive", F.lit(True)), "h", "left")
    said = F.when(F.col("line").isNotNull() & F.col("excessive").isNull() & ~heads, _words(F.col("line"), F.col("form"))).otherwise(0)
    by_page = counted.groupBy("id").agg(F.max("partial").alias("partial"), F.max("words").alias("words"), F.sum(said).alias("said"), F.sum(F.coalesce("rest", F.lit(0))).alias("rest"), F.count("line").alias("messages"))
    by_page = scratch.keep(by_page.join(own, "id", "left_anti").withColumn("others", F.col("words") - F.col("said") + F.col("rest")), "by_page")
    allowed = F.when(F.col("partial"), 2 * OTHER_WORDS).otherwise(OTHER_WORDS)
    plain = by_page.filter((F.col("messages") > 0) & (F.col("others") <= allowed)).select("id")
    # the other pages of little information are looked at line by line
    doubtful = scratch.keep(by_page.filter((F.col("words") > 0) & (F.col("words") <= LITTLE_WORDS) & ((F.col("messages") == 0) | (F.col("others") > allowed))).select("id", "partial"), "doubtful")
    near = source.drop("partial").join(limited(doubtful), "id")
    title = F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?U)^\s*#")), " ")
    # an answer by a server names the address it is about, and says something around it
    terms = F.filter(F.split(F.lower("line"), r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    heading = F.split(F.concat_ws(" ", F.lower(title), F.regexp_replace(F.lower("url"), r"^[^:]*://[^/]*", "")), r"[^\p{L}]+")
    masked = _body_lines(near).join(near.select("id", "partial", heading.alias("heading")).dropDuplicates(["id"]), "id")
    masked = masked.withColumn("words", _words(F.col("line"), F.col("form")).cast("int")).withColumn("skeleton", skeleton(F.col("line")))
    marks = F.split("skeleton", " ")
    around = F.when(F.array_contains(marks, SLUG), F.size(F.filter(marks, lambda w: ~w.isin(SLUG, NAME, "0")))).otherwise(0)
    low = (F.col("words") <= LINE_WORDS) & (around >= PLAIN_WORDS) & ~F.arrays_overlap(terms, "heading")
    masked = masked.select("id", "site", "partial", "line_no", "h", "words", F.xxhash64("skeleton").alias("sk"), F.xxhash64("form").alias("form"), low.alias("low"))
    told = found.select("id", "line_no", "rest").join(limited(doubtful).select("id"), "id", "left_semi")
    marked = scratch.keep(masked.dropDuplicates(["id", "line_no"]).join(told, ["id", "line_no"], "left").join(hot.withColumn("excessive", F.lit(True)), "h", "left"), "marked")
    # a message stays a message on however many pages a host shows it; any other line that it repeats is none of the page's own
    chrome = marked.filter("excessive and rest is null").select("sk").distinct()
    asked = scratch.keep(marked.filter("excessive is null and rest is null and h is not null").select("h").distinct(), "asked")
    again = lines.join(limited(asked), "h", "left_semi").select("h", "id").distinct().groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= AGAIN).select("h", F.lit(True).alias("again"))
    owned = marked.filter("excessive is null or rest is not null").join(limited(scratch.keep(chrome, "chrome")), "sk", "left_anti").join(limited(scratch.keep(again, "again")), "h", "left")
    rest = scratch.keep(owned.filter("again is null or rest is not null").drop("again"), "rest")
    scratch.drop("lines")
    # a copied paragraph is the same text on several hosts; a response has the same skeleton around different names
    forms = rest.filter("low and rest is null").select("sk", "site", "form").distinct()
    texts = forms.select("sk", "form").distinct().groupBy("sk").agg(F.count("*").alias("texts")).filter(F.col("texts") >= HOSTS)
    hosts = forms.select("sk", "site").distinct().groupBy("sk").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= HOSTS)
    spread = hosts.join(texts, "sk").select("sk", F.lit(True).alias("spread"))
    hit = F.col("rest").isNotNull() | (F.coalesce("spread", F.lit(False)) & F.col("low"))
    judged = rest.join(spread, "sk", "left").withColumn("hit", hit)
    # a heading that is a message isn't among the body's lines
    headed = found.filter(F.col("line").rlike(r"(?U)^\s*#")).select("id").distinct().withColumn("headed", F.lit(True))
    sums = judged.groupBy("id").agg(F.max("hit").alias("hit"), F.max("partial").alias("partial"), F.sum(F.when(F.col("hit"), F.coalesce("rest", F.lit(0))).otherwise(F.col("words"))).alias("others"))
    more = sums.join(headed, "id", "left").filter((F.col("hit") | F.coalesce("headed", F.lit(False))) & (F.col("others") <= allowed)).select("id")
    responses = plain.unionByName(more).select("id", F.lit("response").alias("reason"))
    return own.unionByName(responses).groupBy("id").agg(F.max("reason").alias("reason")).select(F.col("id").alias(id_col), "reason")


def without_residue(pages: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The pages that are left, one row an id."""
    return pages.join(found.select(id_col), id_col, "left_anti").dropDuplicates([id_col])
