"""Sections of markdown by ATX headings: splitting, outlines, lookup, indexes.

A text is split by one pattern that looks ahead for heading lines, so splitting is a projection: no lines are exploded,
nothing is shuffled, and the pieces come in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import BLANKS, body_hash, estimate_tokens, trimmed

_INLINE_BLANKS = BLANKS.replace(r"\t-\r ", r"\t\x0b\x0c\r ")
_HEADING = rf"#{{1,6}}[{_INLINE_BLANKS}]+[^\n\r\x{{2028}}\x{{2029}}]*(?=\n|\z)"
#: Bounds of a stored index.
MAX_SECTIONS = 50
MAX_BYTES = 600_000
INTRO = "(intro)"


def _pieces(markdown: Column) -> Column:
    """Texts of the sections. A blank lead-in is dropped, unless it is all there is; a null text has no sections."""
    parts = F.split(markdown, rf"\n(?={_HEADING})")
    lead = ~parts[0].rlike(rf"^{_HEADING}") & (trimmed(parts[0]) == "")
    return F.when(lead & (F.size(parts) > 1), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)


def _fields(piece: Column) -> list[Column]:
    """heading, level and body of a piece; the lead-in is `(intro)` at level 0."""
    is_heading = piece.rlike(rf"^{_HEADING}")
    line = F.substring_index(piece, "\n", 1)
    heading = trimmed(F.regexp_replace(line, "^#{1,6}", ""))
    level = F.length(F.regexp_extract(line, "^(#{1,6})", 1))
    return [F.when(is_heading, heading).otherwise(F.lit(INTRO)).alias("heading"), F.when(is_heading, level).otherwise(F.lit(0)).alias("level"), F.concat(piece, F.lit("\n")).alias("body")]


def split_sections(pages: DataFrame, *keys: str, text_col: str = "markdown") -> DataFrame:
    """(keys, pos, heading, level, body, sha256, tokens): a row a section, pos from 0. Repeated rows give repeated sections."""
    rows = pages.select(*keys, F.posexplode(_pieces(F.col(text_col))).alias("pos", "_piece"))
    return rows.select(*keys, "pos", *_fields(F.col("_piece"))).withColumn("sha256", body_hash("body")).withColumn("tokens", estimate_tokens("body"))


def section_array(markdown: Column | str) -> Column:
    """The sections as an array of struct<heading, level, body, sha256, tokens>."""
    c = F.col(markdown) if isinstance(markdown, str) else markdown

    def entry(piece: Column) -> Column:
        heading, level, body = _fields(piece)
        text = F.concat(piece, F.lit("\n"))
        return F.struct(heading, level, body, body_hash(text).alias("sha256"), estimate_tokens(text).alias("tokens"))

    return F.transform(_pieces(c), entry)


def outline(sections: DataFrame) -> DataFrame:
    """Of section rows, the headings down to level 3 without the lead-in."""
    return sections.filter((F.col("heading") != INTRO) & (F.col("level") <= 3))


def outline_text(sections: DataFrame, *keys: str) -> DataFrame:
    """(keys, outline): one indented line a heading, in document order."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), F.col("heading"), F.lit("  (~"), F.col("tokens").cast("string"), F.lit(" tok)"))
    rows = outline(sections).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return rows.select(*keys, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("outline"))


def find_section(sections: Column, wanted: Column | str, with_intro: bool = True) -> Column:
    """Text under a heading: the first that equals `wanted`, else the first that contains it, with its subsections, trimmed.

    Without the lead-in this reads a text afresh; with it, a stored index, where a lead-in that matches stands for the whole
    page. Null where nothing matches.
    """
    query = F.lower(trimmed(F.lit(wanted) if isinstance(wanted, str) else wanted))
    entries = F.coalesce(sections, F.array().cast("array<struct<heading:string,level:int,body:string,sha256:string,tokens:bigint>>"))
    if not with_intro:
        entries = F.filter(entries, lambda s: s["level"] > 0)
    names = F.transform(entries, lambda s: F.coalesce(F.lower(trimmed(s["heading"])), F.lit("")))
    exact = F.array_position(names, query)
    start = F.when(exact > 0, exact).otherwise(F.array_position(F.transform(names, lambda n: F.contains(n, query)), True)).cast("int")
    rest = F.slice(entries, start + 1, F.size(entries))
    level = F.get(entries, start - 1)["level"]
    stop = F.array_position(F.transform(rest, lambda s: s["level"] <= level), True).cast("int")
    length = F.when(stop > 0, stop).otherwise(F.size(entries) - start + 1)
    return F.when(start > 0, trimmed(F.array_join(F.transform(F.slice(entries, start, length), lambda s: F.coalesce(s["body"], F.lit(""))), "")))


def build_index(pages: DataFrame, *keys: str, text_col: str = "markdown") -> DataFrame:
    """(keys, sections): null where a page has more sections or bytes than an index may hold."""
    made = pages.select(*keys, section_array(F.col(text_col)).alias("sections"))
    size = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["body"]))
    return made.withColumn("sections", F.when((F.size("sections") <= MAX_SECTIONS) & (size <= MAX_BYTES), F.col("sections")))


def diff_indexes(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, heading, level, body, change) of the sections of `after` that are `added`, `changed` or `same`, and of those `removed`.

    Sections are matched by heading in lower case; of several equal headings before, the last counts. pos is the place on
    its own side. Pages that stand on one side only are all added or removed.
    """
    name = F.lower(trimmed(F.col("heading")))
    old = before.select(*keys, name.alias("_name"), "pos", "heading", "level", "sha256")
    last = old.groupBy(*keys, "_name").agg(F.max_by("sha256", "pos").alias("_sha256"))
    new = after.select(*keys, name.alias("_name"), "pos", "heading", "level", "body", "sha256")
    current = new.join(last.withColumn("_old", F.lit(True)), [*keys, "_name"], "left").select(
        *keys, "pos", "heading", "level", "body", F.when(F.col("_old").isNull(), "added").when(F.col("sha256").eqNullSafe(F.col("_sha256")), "same").otherwise("changed").alias("change")
    )
    gone = old.join(new.select(*keys, "_name").distinct(), [*keys, "_name"], "left_anti").select(*keys, "pos", "heading", "level", F.lit(None).cast("string").alias("body"), F.lit("removed").alias("change"))
    return current.unionByName(gone)


def delta_counts(diff: DataFrame, *keys: str) -> DataFrame:
    """(keys, changed, added, removed, unchanged, total)."""
    return diff.groupBy(*keys).agg(
        *(F.count_if(F.col("change") == c).alias(n) for c, n in (("changed", "changed"), ("added", "added"), ("removed", "removed"), ("same", "unchanged"))), F.count_if(F.col("change") != "removed").alias("total")
    )


def delta_text(diff: DataFrame, *keys: str) -> DataFrame:
    """(keys, delta): changed bodies, then added ones, then the headings removed, each in document order."""
    order = F.when(F.col("change") == "changed", 0).when(F.col("change") == "added", 1).otherwise(2)
    rows = diff.filter("change != 'same'").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "pos", trimmed("body").alias("text"), "heading"))).alias("parts"))
    bodies = F.transform(F.filter("parts", lambda p: p["o"] < 2), lambda p: p["text"])
    gone = F.transform(F.filter("parts", lambda p: p["o"] == 2), lambda p: p["heading"])
    removed = F.when(F.size(gone) > 0, F.concat(F.lit("_Removed since then: "), F.array_join(gone, ", "), F.lit("_")))
    return rows.select(*keys, F.concat_ws("\n\n", bodies, removed).alias("delta"))
