"""Lines repeated across one site's documents.

Hash normalized lines, count distinct documents for each site and hash, keep the hashes over the threshold by share of
the site's documents, join back, and rebuild the documents without those lines.

Null or empty texts have no lines that count. A null or unparsable address belongs to the site `unknown`. Rows with
the same id count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.sources.scratch import Scratch

MIN_FORM = 20
MIN_PAGES = 6
MIN_SHARE_PERCENT = 5
#: Rows of a long or two that may be broadcast: as a hash relation a row takes about 60 bytes, so these are some 18 MB. Beyond, the join shuffles.
BROADCAST_ROWS = 300_000


def limited(rows: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it was counted and found within the bound."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def site_of(url: Column) -> Column:
    """Host in lower case without userinfo, port and a leading `www.`; `unknown` where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.isNull() | (host == ""), F.lit("unknown")).otherwise(host)


def line_form(line: Column) -> Column:
    """Lower case, runs of digits as one 0, runs of letters and digits joined by one blank."""
    digits = F.regexp_replace(F.lower(line), "[0-9]+", "0")
    return F.trim(F.regexp_replace(digits, r"[^\p{L}\p{N}]+", " "))


def exploded_lines(pages: DataFrame, text_col: str, *columns: Column | str) -> DataFrame:
    """(columns, line_no, line, form) of the lines that aren't headings and have a letter or digit.

    Forms are made before the lines are exploded: afterwards each is a value, where a column would be worked out anew for every filter and use.
    """

    def made(line: Column) -> Column:
        heading = F.contains(line, F.lit("#")) & line.rlike(r"(?U)^\s*#")
        return F.struct(line.alias("line"), F.when(~heading, line_form(line)).otherwise("").alias("form"))

    at = pages.select(*columns, F.posexplode(F.transform(F.split(F.col(text_col), "\n"), made)).alias("line_no", "_x"))
    kept = [c for c in at.columns if c not in ("line_no", "_x")]
    return at.filter("_x.form != ''").select(*kept, F.col("line_no").cast("long").alias("line_no"), "_x.line", "_x.form")


def hashed_lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "markdown", url_col: str = "url") -> DataFrame:
    """(id, line_no, site_key, h) of each line that counts; h is the hash of site and form."""
    at = exploded_lines(pages, text_col, F.col(id_col).alias("id"), site_of(F.col(url_col)).alias("site"))
    return at.filter(F.length("form") >= MIN_FORM).select("id", "line_no", F.xxhash64("site").alias("site_key"), F.xxhash64("site", "form").alias("h"))


def frequent_hashes(lines: DataFrame, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", min_pages: int = MIN_PAGES, share_percent: float = MIN_SHARE_PERCENT) -> DataFrame:
    """h of the forms that stand in at least min_pages documents and share_percent of the site's documents.

    Both counts go through a distinct by (key, id) first, so a line on a third of all documents is spread over all tasks
    and reaches its final group as one partial count a task.
    """
    counts = lines.select("site_key", "h", "id").distinct().groupBy("site_key", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    sites = pages.select(F.xxhash64(site_of(F.col(url_col))).alias("site_key"), F.col(id_col).alias("id")).distinct().groupBy("site_key").agg(F.count("*").alias("site_n"))
    return counts.join(sites, "site_key").filter(F.col("n") * 100 >= F.col("site_n") * share_percent).select("h", "n", "site_n")


def frequent_lines(pages: DataFrame, id_col: str = "page_id", text_col: str = "markdown", url_col: str = "url", min_pages: int = MIN_PAGES, share_percent: float = MIN_SHARE_PERCENT) -> DataFrame:
    """(id_col, line_no) of every appearance of a line that its site repeats excessively."""
    scratch = Scratch(pages.sparkSession, "p1")
    lines = scratch.keep(hashed_lines(pages, id_col, text_col, url_col), "lines")
    hot = scratch.keep(frequent_hashes(lines, pages, id_col, url_col, min_pages, share_percent).select("h"), "frequent")
    return lines.join(limited(hot), "h", "left_semi").select(F.col("id").alias(id_col), "line_no").distinct()


def without_lines(pages: DataFrame, found: DataFrame, id_col: str = "page_id", text_col: str = "markdown") -> DataFrame:
    """One row a document: the text without the found lines, and how many were removed.

    A document keeps its text as it is when nothing was found; a null text stays null.
    """
    drop = found.groupBy(id_col).agg(F.collect_set("line_no").alias("_drop"))
    once = pages.select(id_col, text_col).dropDuplicates([id_col])
    # the numbers that stay are told by hash, not by looking through the dropped ones for each line
    kept = F.expr(f"array_join(transform(array_except(sequence(0L, cast(size(split({text_col}, '\\n')) - 1 as bigint)), _drop), i -> split({text_col}, '\\n')[cast(i as int)]), '\\n')")
    return once.join(drop, id_col, "left").select(id_col, F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(kept).alias(text_col), F.coalesce(F.size("_drop"), F.lit(0)).alias("removed"))
