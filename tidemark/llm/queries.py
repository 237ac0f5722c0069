"""Queries of this subpackage over the provided tables, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import p1_lines, p2_residue, p3_split, p4_near, p6_frequent, p7_tokens, p8_leaks, p9_spans
from tidemark.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _pages(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "cached_page", "page_id", "url", "markdown")


def _hinted_pages(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "cached_page", "page_id", "url", "markdown", "spa_partial")


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents", "doc_id", "text")


def _sections(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "section_index", "page_id", "sections")


def _events(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "demand_event", "seq", "url", "domain")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_lines.frequent_lines(_pages(spark, root))


def p1_clean(spark: SparkSession, root: str) -> DataFrame:
    pages = _pages(spark, root)
    return p1_lines.without_lines(pages, p1_lines.frequent_lines(pages))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_residue.residue_pages(_hinted_pages(spark, root)).select("page_id")


def p2_clean(spark: SparkSession, root: str) -> DataFrame:
    pages = _hinted_pages(spark, root)
    return p2_residue.without_residue(pages, p2_residue.residue_pages(pages)).select("page_id", "markdown")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_split.split_sections(_sections(spark, root)).select("page_id", "pos").distinct()


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    return p3_split.split_sections(_sections(spark, root)).distinct()


def p3_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    return p3_split.rebuilt(p3_pieces(spark, root)).drop("pieces")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_near.NearDuplicates(_pages(spark, root)).pairs()


def p4_groups(spark: SparkSession, root: str) -> DataFrame:
    return p4_near.NearDuplicates(_pages(spark, root)).groups()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_frequent.heavy_hitters(_events(spark, root), {"url": 0.004, "domain": 0.02}).select("field", "value")


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    return p6_frequent.heavy_hitters(_events(spark, root), {"url": 0.004, "domain": 0.02})


def p6_top_urls(spark: SparkSession, root: str) -> DataFrame:
    return p6_frequent.top_k(_events(spark, root), "url", 100)


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return p7_tokens.encode_corpus(_documents(spark, root))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return p8_matches(spark, root).select("doc_id", "item_id")


def p8_matches(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks.leaked_items(_documents(spark, root), read_table(spark, root, "eval_item", "item_id", "passage"))


def p8_clean(spark: SparkSession, root: str) -> DataFrame:
    return p8_leaks.without_leaks(_documents(spark, root), p8_matches(spark, root))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_spans.shared_spans(_documents(spark, root))


def p9_portion(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    return p9_spans.shared_portion(documents, p9_spans.shared_spans(documents))


def p9_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return p9_spans.repeated_paragraphs(_documents(spark, root))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_clean, p2_found, p2_clean, p3_found, p3_pieces, p3_rebuilt, p4_found, p4_groups, p6_found, p6_counts, p6_top_urls, p7_ids, p8_found, p8_matches, p8_clean, p9_found, p9_portion, p9_paragraphs)
}

_P1_HOT = r"""
with pages as (select distinct page_id, markdown,
    coalesce(nullif(regexp_replace(regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '^www\.', ''), ''), 'unknown') as site from cached_page),
  lines as (select page_id, site, markdown, unnest(string_split(markdown, chr(10))) as line, unnest(range(len(string_split(markdown, chr(10))))) as line_no from pages),
  forms as (select page_id, site, line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) as form from lines where not regexp_matches(line, '^\s*#')),
  hot as (select site, form from forms join (select site, count(distinct page_id) as site_n from pages group by site) using (site)
    where length(form) >= 20 group by site, form, site_n having count(distinct page_id) >= 6 and count(distinct page_id) * 100 >= site_n * 5),
  found as (select distinct page_id, line_no from forms join hot using (site, form))
"""
_P6 = """
with e as (select distinct seq, url, domain from demand_event),
  c as (select 'url' as field, url as value, count(*) as n from e where url is not null group by url union all select 'domain', domain, count(*) from e where domain is not null group by domain),
  r as (select field, value, n, (select count(distinct seq) from e) as total from c)
"""

_P4 = r"""
with w as (select distinct page_id, regexp_extract_all(lower(markdown), '[\p{L}\p{N}]+') as ws from cached_page),
  g as (select distinct page_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from (select page_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 100)),
  n as (select page_id, count(*) as n from g group by page_id),
  c as (select a.page_id as a, b.page_id as b, count(*) as k from g a join g b on a.s = b.s and a.page_id < b.page_id group by 1, 2),
  pairs as (select a as page_id_a, b as page_id_b from c join n x on x.page_id = a join n y on y.page_id = b where k / (x.n + y.n - k)::double >= 0.7)
"""
_P8 = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents),
  v as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as ws from eval_item),
  a as (select distinct doc_id, array_to_string(ws[i : i + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
  b as (select distinct item_id, array_to_string(ws[i : i + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as i from v where len(ws) >= 12)),
  leaks as (select doc_id, item_id from a join b using (g))
"""
_P9 = """
with w as (select doc_id, text, unnest(range(0, length(text) - 319)) as s from (select distinct doc_id, text from documents where length(text) >= 320)),
  h as (select doc_id, s, md5(substr(text, s + 1, 320)) as h from w),
  p as (select doc_id, s from h where h in (select h from h group by h having count(distinct doc_id) > 1)),
  o as (select *, case when s <= max(s + 320) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) then 0 else 1 end as o from p),
  r as (select *, sum(o) over (partition by doc_id order by s) as k from o),
  spans as (select doc_id, min(s) as span_start, max(s) + 320 as span_end from r group by doc_id, k)
"""

ORACLE: dict[str, str] = {
    "p1_found": _P1_HOT + "select page_id, line_no from found",
    "p1_clean": _P1_HOT
    + """select page_id, coalesce(k.markdown, case when p.markdown is null then null when r.removed > 0 then '' else p.markdown end) as markdown, cast(coalesce(r.removed, 0) as int) as removed from pages p
    left join (select page_id, string_agg(line, chr(10) order by line_no) as markdown from lines where (page_id, line_no) not in (select (page_id, line_no) from found) group by page_id) k using (page_id)
    left join (select page_id, count(*) as removed from found group by page_id) r using (page_id)""",
    "p3_found": """select distinct page_id, cast(pos as bigint) as pos from (select page_id, unnest(range(len(sections))) as pos, unnest(sections) as s from section_index)
    where length(s.body) + length(regexp_replace(s.body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 2000""",
    "p3_rebuilt": """select page_id, pos, body, true as within from
    (select distinct page_id, pos, s.body as body, length(s.body) + length(regexp_replace(s.body, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) as units from
      (select page_id, cast(unnest(range(len(sections))) as bigint) as pos, unnest(sections) as s from section_index)) where units > 2000""",
    "p6_found": _P6 + "select field, value from r where (field = 'url' and n * 1000 >= total * 4) or (field = 'domain' and n * 100 >= total * 2)",
    "p6_counts": _P6 + "select field, value, n, total from r where (field = 'url' and n * 1000 >= total * 4) or (field = 'domain' and n * 100 >= total * 2)",
    "p6_top_urls": _P6 + "select value, n from r where field = 'url' order by n desc, value limit 100",
    "p9_paragraphs": """
with parts as (select distinct doc_id, unnest(string_split(text, chr(10) || chr(10))) as p, unnest(range(len(string_split(text, chr(10) || chr(10))))) as pos from documents),
  placed as (select doc_id, p, coalesce(sum(length(p) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as s from parts),
  forms as (select doc_id, cast(s as bigint) as s, cast(s + length(p) as bigint) as e, trim(regexp_replace(lower(p), '\\s+', ' ', 'g')) as form from placed),
  firsts as (select doc_id, s, e, first_value(doc_id) over w as kept_doc, first_value(s) over w as kept_start from forms where length(form) >= 40 window w as (partition by form order by doc_id, s))
select doc_id, s as span_start, e as span_end, kept_doc, kept_start from firsts where doc_id <> kept_doc or s <> kept_start""",
    "p4_found": _P4 + "select * from pairs",
    "p4_groups": _P4.replace("with w as", "with recursive w as")
    + """, ends as (select page_id_a as a, page_id_b as b from pairs union all select page_id_b, page_id_a from pairs),
  reach(id, far) as (select page_id, page_id from n union select reach.id, ends.b from reach join ends on ends.a = reach.far)
select id as page_id, min(far) as group_id, (select count(*) from ends where a = id) as links from reach group by id""",
    "p8_found": _P8 + "select distinct doc_id, item_id from leaks",
    "p8_matches": r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents),
  v as (select distinct item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as ws from eval_item),
  a as (select doc_id, i, array_to_string(ws[i : i + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as i from w where len(ws) >= 12)),
  b as (select item_id, j, array_to_string(ws[j : j + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as j from v where len(ws) >= 12)),
  m as (select doc_id, item_id, i, i - j as shift from a join b using (g)),
  r as (select *, i - row_number() over (partition by doc_id, item_id, shift order by i) as run from m),
  n as (select doc_id, item_id, count(*) + 11 as match_words, min(i) - 1 as first_word from r group by doc_id, item_id, shift, run)
select doc_id, item_id, match_words, first_word from n qualify row_number() over (partition by doc_id, item_id order by match_words desc, first_word) = 1""",
    "p8_clean": _P8 + "select doc_id, text from documents where doc_id not in (select doc_id from leaks)",
    "p9_found": _P9 + "select * from spans",
    "p9_portion": _P9
    + """select d.doc_id, n_chars, coalesce(shared, 0) as shared_chars, case when n_chars > 0 then coalesce(shared, 0) / n_chars::double else 0.0 end as share
from (select doc_id, max(coalesce(length(text), 0)) as n_chars from documents group by doc_id) d left join (select doc_id, cast(sum(span_end - span_start) as bigint) as shared from spans group by doc_id) s using (doc_id)""",
}
