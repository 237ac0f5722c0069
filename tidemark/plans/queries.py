"""Queries over the provided tables by name, and the SQL that checks them.

Each runs over its whole tables. Where a table of the access log is redelivered, rows count once by their id; `stream_totals`
alone counts deliveries. Times are compared with NOW, which stands for the caller's clock.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import addresses, html, rendering, text, urls
from tidemark.operators import answers, cutoffs, demand, notes, pages, replay, sections, stats, store, windows
from tidemark.operators.order import with_previous
from tidemark.operators.snapshots import snapshot_changes
from tidemark.plans import sql as S
from tidemark.sources.feeds import release_times
from tidemark.sources.scratch import Scratch, small_side
from tidemark.sources.tables import read_once, read_table, spread
from tidemark.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NOW = 1_769_650_000_000
SINCE = 1_768_000_000_000
HOUR = 3_600_000


def query(check: str | None = None):
    """Registers a query under the function's name, with the SQL that checks it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if check:
            ORACLE[f.__name__] = check
        return f

    return register


def _saves(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Saves, once each; texts aren't moved to tell which were delivered twice."""
    if "markdown" in columns:
        return read_once(spark, root, "cached_page", "page_id", *columns)
    return read_table(spark, root, "cached_page", "page_id", *columns).dropDuplicates(["page_id"])


# ---- text


@query(f"select doc_id, {S.units('text')} as units, {S.tokens('text')} as tokens from documents")
def est_tokens(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents", "doc_id", "text").select("doc_id", text.utf16_units("text").alias("units"), text.estimate_tokens("text").alias("tokens"))


@query("select distinct page_id, left(sha256(markdown), 16) as content_hash, sha256(markdown) as body_hash, coalesce(lower(content_hash) = left(sha256(markdown), 16), false) as stored from cached_page")
def text_hashes(spark: SparkSession, root: str) -> DataFrame:
    rows = _saves(spark, root, "markdown", "content_hash")
    stored = F.coalesce(F.lower("content_hash") == text.content_hash("markdown"), F.lit(False))
    return rows.select("page_id", stored.alias("stored"), text.content_hash("markdown").alias("content_hash"), text.body_hash("markdown").alias("body_hash"))


@query(
    r"""select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as form,
  left("""
    + S.trim(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x{{00}}-\x{{1f}}\x{{7f}}]', ' ', 'g'), '`+', '''', 'g'), '[<>]', '', 'g'), '[{S.BLANKS}]+', ' ', 'g')")
    + r""", 500) as clean,
  coalesce(regexp_matches(text, '(?i)\b(?:ignore (?:all|the|previous|above)|disregard (?:all|the|previous)|system prompt|you are now|new instructions?|act as|jailbreak|developer mode|override (?:your|the) (?:instructions|rules))\b'), false) as steering
from documents"""
)
def note_forms(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents", "doc_id", "text")
    return rows.select("doc_id", text.dedup_form("text").alias("form"), text.clean_note("text").alias("clean"), text.is_steering("text").alias("steering"))


@query(
    rf"""with w as (select doc_id, text, {S.tokens("text")} as n, left(regexp_replace(text, '({S.ASTRAL})', '\1' || chr(57344), 'g'), 400) as p, substr(regexp_replace(text, '({S.ASTRAL})', '\1' || chr(57344), 'g'), 401, 1) as nx from documents),
  h as (select doc_id, text, n, replace(case when nx = chr(57344) then left(p, 399) else p end, chr(57344), '') as head from w),
  c as (select *, len(string_split(head, chr(10) || chr(10))) as k, left(head, length(head) - length(list_extract(string_split(head, chr(10) || chr(10)), -1)) - 2) as cut from h)
select doc_id, case when n <= 100 or text is null then text else {S.trim(f"case when k > 1 and {S.units('cut')} > 200 then cut else head end")} || chr(10) || chr(10) || '_[clipped to ~100 tokens]_' end as clipped from c"""
)
def clip_budget(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents", "doc_id", "text").select("doc_id", text.clip_to_budget("text", 100).alias("clipped"))


@query(
    """select distinct page_id, greatest(0, coalesce(original_tokens, 0) - coalesce(distilled_tokens, 0)) as saved,
  cast(case when coalesce(original_tokens, 0) = 0 then 0 else floor(greatest(0, coalesce(original_tokens, 0) - coalesce(distilled_tokens, 0)) * 100 / original_tokens::double + 0.5) end as bigint) as percent from cached_page"""
)
def savings(spark: SparkSession, root: str) -> DataFrame:
    saved = text.tokens_saved("original_tokens", "distilled_tokens")
    return _saves(spark, root, "original_tokens", "distilled_tokens").select("page_id", saved.alias("saved"), text.percent_saved(saved, "original_tokens").alias("percent"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def parsed_props(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events", "event_id", "props").select("event_id", text.parsed_json("props", "k long")["k"].alias("k"))


@query("select distinct seq, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' else (s // 3600) || 'h' end as age from (select seq, (1769650000000 - at_ms) // 1000 as s from activity)")
def activity_ages(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "activity", "seq", "at_ms").dropDuplicates(["seq"]).select("seq", text.relative_age("at_ms", NOW).alias("age"))


# ---- addresses


@query(f"select distinct page_id, {S.URL_HASH} as url_hash, {S.SITE} as site, {S.DOC_SET} as docset from {S.url_parts('cached_page', keys='page_id')}")
def url_keys(spark: SparkSession, root: str) -> DataFrame:
    return _saves(spark, root, "url").select("page_id", urls.url_hash("url").alias("url_hash"), urls.site("url").alias("site"), urls.doc_set("url").alias("docset"))


_TRACKED = "('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'mc_cid', 'mc_eid', 'igshid', '_ga', 'yclid', 'msclkid', 'ref_src')"
_PARAMS = "string_split(regexp_replace(query, '^\\?', ''), '&')"


@query(
    f"""with p as (select *, list_filter({_PARAMS}, lambda x: x <> '' and lower(split_part(x, '=', 1)) not in {_TRACKED}) as kept, len(list_filter({_PARAMS}, lambda x: lower(split_part(x, '=', 1)) in {_TRACKED})) > 0 as tracked,
    regexp_replace(host, '^www\\.', '') as bare, valid and scheme in ('http', 'https') as web from {S.url_parts("(select distinct url from demand_event where url is not null)")}),
  m as (select *, case when web then scheme || '://' || usr || case when bare = 'ar5iv.labs.arxiv.org' then 'ar5iv.org' else bare end || {S.PORT} || {S.NO_SLASH}
    || case when tracked then case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end else query end else raw end as canonical_url from p)
select raw as url, canonical_url, case when not web then 'raw' when bare = 'ar5iv.labs.arxiv.org' then 'mirror' when canonical_url = raw then 'raw' else 'normalized' end as kind from m"""
)
def url_canonical(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "demand_event", "url").filter("url is not null").distinct()
    return rows.withColumn("c", urls.canonical("url")).select("url", "c.canonical_url", "c.kind")


@query(
    f"""with s as (select distinct source as target from documents union select distinct url from cached_page)
select s.target, case when regexp_matches(s.target, '(?i)^https?://') then 'u:' || {S.URL_HASH} else 't:' || left(regexp_replace(regexp_replace(lower(s.target), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) end as key
from s left join {S.url_parts("(select distinct url from cached_page)")} on raw = s.target"""
)
def note_keys(spark: SparkSession, root: str) -> DataFrame:
    targets = read_table(spark, root, "documents", F.col("source").alias("target")).union(read_table(spark, root, "cached_page", "url")).distinct()
    return targets.select("target", urls.target_key("target").alias("key"))


@query(
    """with n as (select event_id, (event_id * 2654435761) % 4294967296 as ip from events),
  p as (select event_id, ip, (ip >> 24) || '.' || ((ip >> 16) & 255) || '.' || ((ip >> 8) & 255) || '.' || (ip & 255) as dotted from n)
select event_id, dotted, ip as number, (ip >> 24) in (0, 10, 127) or ip >> 22 = 401 or ip >> 16 in (43518, 49320) or ip >> 20 = 2753 or ip >> 8 = 12582912 or ip >> 17 = 25353 or ip >> 28 in (14, 15) as private from p"""
)
def private_addresses(spark: SparkSession, root: str) -> DataFrame:
    number = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))
    dotted = F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
    rows = read_table(spark, root, "events", "event_id").select("event_id", dotted.alias("dotted"))
    return rows.select("event_id", "dotted", addresses.ipv4_number("dotted").alias("number"), addresses.is_private("dotted").alias("private"))


@query(
    f"""select raw as url, case when not valid then 'invalid' when scheme not in ('http', 'https') then 'scheme' when host = 'localhost' or host like '%.local' or host like '%.internal' then 'internal' end as refusal
from {S.url_parts("(select distinct url from demand_event where url is not null)")}"""
)
def refusals(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "demand_event", "url").filter("url is not null").distinct()
    return rows.select("url", addresses.refusal("url").alias("refusal"))


@query("select c.c_custkey, coalesce(nullif(trim(split_part(xff, ',', 1)), ''), 's:' || c_name) as client from (select c_custkey, c_name, case when c_custkey % 2 = 0 then ' 10.0.0.' || c_nationkey || ' , 10.1.1.1' else '' end as xff from customer) c")
def client_keys(spark: SparkSession, root: str) -> DataFrame:
    header = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" 10.0.0."), F.col("c_nationkey").cast("string"), F.lit(" , 10.1.1.1"))).otherwise(F.lit(""))
    return read_table(spark, root, "customer", "c_custkey", "c_name", "c_nationkey").select("c_custkey", urls.client_key(header, "c_name").alias("client"))


@query("""select doc_id, case when lang in ('en', 'de', 'fr', 'es', 'ja') then true when lang is null then true else false end and coalesce(strlen(text), 0) <= 3000000 as admitted from documents""")
def admitted_responses(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("lang").isin("en", "de", "fr", "es", "ja"), "Text/HTML; charset=utf-8").when(F.col("lang").isNotNull(), "image/png")
    return read_table(spark, root, "documents", "doc_id", "lang", "text").select("doc_id", (addresses.is_text_type(kind) & addresses.within_bytes("text")).alias("admitted"))


# ---- HTML


def _as_html(markdown) -> F.Column:
    """A page around the text, with the parts that distillation takes away."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(markdown, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    return F.concat(
        F.lit("<html><head><style>p { margin: 0 }</style></head><body><!-- top --><nav>menu</nav><article style=\"color: red\"><p style='x'>"),
        F.regexp_replace(body, "\n\n+", "</p>\n<p>"),
        F.lit("</p><img src=\"data:image/png;base64,AAAA\" alt=\"\"></article><script>var a = '<p>';</script><NOSCRIPT>on</NOSCRIPT><svg><path/></svg><footer>end</footer></body></html>"),
    )


_HTML = """'<html><head><style>p { margin: 0 }</style></head><body><!-- top --><nav>menu</nav><article style="color: red"><p style=''x''>' ||
  regexp_replace(replace(replace(replace(markdown, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\n\\n+', '</p>' || chr(10) || '<p>', 'g') ||
  '</p><img src="data:image/png;base64,AAAA" alt=""></article><script>var a = ''<p>'';</script><NOSCRIPT>on</NOSCRIPT><svg><path/></svg><footer>end</footer></body></html>'"""
_TRIMMED = "h"
for _pattern in ("<!--.*?-->", r"<script\b.*?</script>", r"<style\b.*?</style>", r"<noscript\b.*?</noscript>", r"<svg\b.*?</svg>", r"<template\b.*?</template>"):
    _TRIMMED = f"regexp_replace({_TRIMMED}, '(?is){_pattern}', '', 'g')"
for _quote in ('"', "''"):
    _TRIMMED = f"regexp_replace({_TRIMMED}, '(?i)\\ssrc={_quote}data:[^\"'']*{_quote}', ' src=\"\"', 'g')"
    _TRIMMED = f"regexp_replace({_TRIMMED}, '(?i)\\sstyle={_quote}[^\"'']*{_quote}', '', 'g')"


@query(f"select page_id, {_TRIMMED} as html from (select distinct page_id, {_HTML} as h from cached_page)")
def html_pretrim(spark: SparkSession, root: str) -> DataFrame:
    return _saves(spark, root, "markdown").select("page_id", html.pretrim(_as_html(F.col("markdown"))).alias("html"))


@query()
def html_distill(spark: SparkSession, root: str) -> DataFrame:
    """Distills each distinct body once, joins it back, and counts what was saved."""
    rows = _saves(spark, root, "markdown").filter("markdown is not null")
    keys = Scratch(spark, "distill").keep(rows.select("page_id", text.body_hash("markdown").alias("h")), "keys")
    first = keys.groupBy("h").agg(F.min("page_id").alias("page_id"))
    page = _as_html(F.col("markdown"))
    once = spread(rows.join(small_side(first), "page_id")).select("h", html.distill_html(page).alias("distilled_text"), text.estimate_tokens(page).alias("original"))
    made = Scratch(spark, "distill").keep(once, "distilled")
    return keys.join(made, "h").select("page_id", F.col("distilled_text").alias("markdown"), "original", text.estimate_tokens("distilled_text").alias("distilled"))


@query()
def distill_savings(spark: SparkSession, root: str) -> DataFrame:
    """One row: tokens of all pages before and after distillation, and the whole percent saved."""
    sums = html_distill(spark, root).agg(F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("distilled"), F.lit(0)).alias("distilled"))
    return sums.withColumn("percent", text.percent_saved(text.tokens_saved("original", "distilled"), "original"))


@query(rf"select page_id, {S.trim(r'''regexp_replace(regexp_replace(regexp_replace(markdown, '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?:\[\]\([^)]*\)\s*)+', '', 'g')''')} as tidy from (select distinct page_id, markdown from cached_page)")
def html_tidy(spark: SparkSession, root: str) -> DataFrame:
    return _saves(spark, root, "markdown").select("page_id", html.tidied(F.col("markdown")).alias("tidy"))


@query(
    f"""select distinct page_id, coalesce(o >= 1000 and d < 150 and ((d / o::double < 0.02 and o > 3000) or regexp_matches(markdown, '(?i)<div[^>]+id=["''](?:root|app|__next)["'']|data-reactroot|__NEXT_DATA__|window\\.__NUXT__|ng-version|<div[^>]+id=["'']svelte')), false) as shell
from (select page_id, markdown, original_tokens as o, {S.tokens("markdown")} as d from cached_page)"""
)
def spa_flag(spark: SparkSession, root: str) -> DataFrame:
    rows = _saves(spark, root, "markdown", "original_tokens")
    return rows.select("page_id", html.looks_unrendered(F.col("markdown"), F.col("original_tokens"), text.estimate_tokens("markdown")).alias("shell"))


@query(
    f"""with r as (select distinct url, first_value(markdown) over (partition by url order by length(markdown) desc, markdown) as rendered from cached_page where rendered_with is not null),
  p as (select distinct page_id, url, markdown, original_tokens, coalesce(spa_partial, false) as shell from cached_page),
  j as (select p.*, rendered, shell and coalesce({S.tokens("rendered")} > {S.tokens("markdown")}, false) as better from p left join r using (url))
select page_id, case when better then greatest(original_tokens, {S.tokens("rendered")}) else original_tokens end as original_tokens, better as rendered, shell and not better as spa_partial, {S.tokens("case when better then rendered else markdown end")} as tokens from j"""
)
def render_choice(spark: SparkSession, root: str) -> DataFrame:
    rendered = read_table(spark, root, "cached_page", "url", "markdown", "rendered_with").filter("rendered_with is not null")
    best = rendered.groupBy("url").agg(F.max(F.struct(F.length("markdown").alias("n"))).alias("m")).select("url", "m.n").join(rendered.select("url", F.length("markdown").alias("n"), "markdown"), ["url", "n"]).groupBy("url").agg(F.min("markdown").alias("rendered"))
    rows = _saves(spark, root, "url", "markdown", "original_tokens", "spa_partial").join(best, "url", "left")
    chosen = html.with_rendered(F.col("markdown"), F.col("original_tokens"), F.coalesce("spa_partial", F.lit(False)), F.col("rendered"), text.estimate_tokens("rendered"))
    return rows.select("page_id", chosen.alias("c")).select("page_id", "c.original_tokens", "c.rendered", "c.spa_partial", text.estimate_tokens("c.markdown").alias("tokens"))


# ---- sections


@query(f"with {S.SECTIONS} select page_id, pos, heading, level, body, sha256, tokens from sections")
def section_rows(spark: SparkSession, root: str) -> DataFrame:
    return sections.split_sections(_saves(spark, root, "markdown"), "page_id")


@query(f"with {S.SECTIONS} select page_id, string_agg(repeat('  ', greatest(0, level - 1)) || '- ' || heading || '  (~' || tokens || ' tok)', chr(10) order by pos) as outline from sections where level between 1 and 3 group by page_id")
def outline_text(spark: SparkSession, root: str) -> DataFrame:
    return sections.outline_text(sections.split_sections(_saves(spark, root, "markdown"), "page_id"), "page_id")


_READ = """, q as (select page_id, min(pos) as pos from h where {match} group by page_id),
  s as (select h.page_id, h.pos, h.level from h join q using (page_id, pos)),
  e as (select s.page_id, s.pos, min(h.pos) as stop from s left join h on h.page_id = s.page_id and h.pos > s.pos and h.level <= s.level group by s.page_id, s.pos)"""


@query(
    f"""with {S.SECTIONS}, h as (select * from sections where level > 0), x as (select page_id, min(case when lower(heading) = 'rows' then pos end) as a, min(case when contains(lower(heading), 'rows') then pos end) as b from h group by page_id),
  s as (select x.page_id, coalesce(a, b) as pos, level from x join h on h.page_id = x.page_id and h.pos = coalesce(a, b)),
  e as (select s.page_id, s.pos, min(h.pos) as stop from s left join h on h.page_id = s.page_id and h.pos > s.pos and h.level <= s.level group by s.page_id, s.pos)
select p.page_id, t.body from (select distinct page_id from cached_page) p left join (select e.page_id, {S.trim("string_agg(body, '' order by h.pos)")} as body from e join h on h.page_id = e.page_id and h.pos >= e.pos and (e.stop is null or h.pos < e.stop) group by e.page_id) t using (page_id)"""
)
def section_read(spark: SparkSession, root: str) -> DataFrame:
    return _saves(spark, root, "markdown").select("page_id", sections.find_section(sections.section_array("markdown"), " Rows ", with_intro=False).alias("body"))


@query(
    f"""with i as (select distinct page_id, sections from section_index), h as (select page_id, unnest(sections) as s, unnest(range(len(sections))) as pos from i),
  n as (select page_id, pos, coalesce(lower({S.trim("s.heading")}), '') as name, s.level as level, coalesce(s.body, '') as body from h),
  x as (select page_id, min(case when name = 'cache' then pos end) as a, min(case when contains(name, 'cache') then pos end) as b from n group by page_id),
  s as (select x.page_id, coalesce(a, b) as pos, level from x join n on n.page_id = x.page_id and n.pos = coalesce(a, b)),
  e as (select s.page_id, s.pos, min(n.pos) as stop from s left join n on n.page_id = s.page_id and n.pos > s.pos and n.level <= s.level group by s.page_id, s.pos)
select e.page_id, {S.trim("string_agg(body, '' order by n.pos)")} as body from e join n on n.page_id = e.page_id and n.pos >= e.pos and (e.stop is null or n.pos < e.stop) group by e.page_id"""
)
def index_read(spark: SparkSession, root: str) -> DataFrame:
    index = read_table(spark, root, "section_index", "page_id", "sections").distinct()
    return index.select("page_id", sections.find_section(F.col("sections"), "cache").alias("body")).filter("body is not null")


@query(f"with {S.SECTIONS} select page_id, case when count(*) <= 50 and sum(strlen(body)) <= 600000 then count(*) end as entries from sections group by page_id")
def index_sizes(spark: SparkSession, root: str) -> DataFrame:
    made = sections.build_index(_saves(spark, root, "markdown").filter("markdown is not null"), "page_id")
    return made.select("page_id", F.size("sections").cast("long").alias("entries"))


_CHAIN = f"""saves as (select page_id, hash, created_at, markdown, lag(page_id) over (partition by hash order by created_at, page_id) as prior
    from (select distinct page_id, created_at, markdown, {S.URL_HASH} as hash from {S.url_parts("cached_page", keys="page_id, created_at, markdown")}))"""


def _chain(spark: SparkSession, root: str) -> DataFrame:
    """(page_id, prior): each save and the save of the same address before it."""
    rows = _saves(spark, root, "url", "created_at").withColumn("url_hash", urls.url_hash("url"))
    return with_previous(rows.select("page_id", "url_hash", "created_at"), "url_hash", ["created_at", "page_id"], "page_id", "prior").select("page_id", "prior")


def _diff(spark: SparkSession, root: str) -> DataFrame:
    """Sections of each save against those of the save of the same address before it; the order is told from narrow rows, texts come last."""
    chain = Scratch(spark, "diff").keep(_chain(spark, root).filter("prior is not null"), "chain")
    texts = _saves(spark, root, "markdown")
    after = sections.split_sections(texts.join(small_side(chain.select("page_id")), "page_id", "left_semi"), "page_id")
    before = sections.split_sections(texts.withColumnRenamed("page_id", "prior").join(small_side(chain), "prior"), "page_id")
    return sections.diff_indexes(before, after, "page_id")


_DIFF = f"""{S.SECTIONS}, {_CHAIN}, pairs as (select page_id, prior from saves where prior is not null),
  cur as (select p.page_id, s.pos, s.heading, s.level, s.body, s.sha256, lower(s.heading) as name from pairs p join sections s on s.page_id = p.page_id),
  old as (select p.page_id, s.pos, s.heading, s.level, s.sha256, lower(s.heading) as name from pairs p join sections s on s.page_id = p.prior),
  last as (select page_id, name, arg_max(sha256, pos) as sha256 from old group by page_id, name),
  diff as (select cur.page_id, pos, heading, level, body, case when last.sha256 is null then 'added' when last.sha256 = cur.sha256 then 'same' else 'changed' end as change from cur left join last using (page_id, name)
    union all select page_id, pos, heading, level, null, 'removed' from old where (page_id, name) not in (select (page_id, name) from cur))"""


@query(f"with {_DIFF} select * from diff")
def section_diff(spark: SparkSession, root: str) -> DataFrame:
    return _diff(spark, root)


@query(f"with {_DIFF} select page_id, count(*) filter (where change = 'changed') as changed, count(*) filter (where change = 'added') as added, count(*) filter (where change = 'removed') as removed, count(*) filter (where change = 'same') as unchanged, count(*) filter (where change <> 'removed') as total from diff group by page_id")
def delta_counts(spark: SparkSession, root: str) -> DataFrame:
    return sections.delta_counts(_diff(spark, root), "page_id")


@query(
    f"""with {_DIFF} select page_id, array_to_string(list_filter([string_agg({S.trim("body")}, chr(10) || chr(10) order by case change when 'changed' then 0 else 1 end, pos) filter (where change in ('changed', 'added')),
  case when count(*) filter (where change = 'removed') > 0 then '_Removed since then: ' || string_agg(heading, ', ' order by pos) filter (where change = 'removed') || '_' end], lambda x: x is not null), chr(10) || chr(10)) as delta
from diff where change <> 'same' group by page_id"""
)
def delta_text(spark: SparkSession, root: str) -> DataFrame:
    return sections.delta_text(_diff(spark, root), "page_id")


@query(
    r"""with h as (select snap_no, url_hash, coalesce(lower(regexp_replace(heading, '^\s+|\s+$', '', 'g')), '(intro)') as heading, loaded_at,
      sha256(regexp_replace(regexp_replace(coalesce(body, ''), '(?m)[ \t\r]+$', '', 'g'), '\n+\z', '')) as digest from section_snapshot),
  r as (select snap_no, url_hash, heading, digest from (select *, row_number() over (partition by snap_no, url_hash, heading order by loaded_at desc nulls last, digest desc) as k from h) where k = 1),
  n as (select snap_no, lag(snap_no) over (order by snap_no) as prev from (select distinct snap_no from r)),
  cur as (select n.snap_no, url_hash, heading, digest from r join n using (snap_no) where prev is not null),
  old as (select n.snap_no, url_hash, heading, digest from r join n on r.snap_no = n.prev)
select coalesce(cur.snap_no, old.snap_no) as snap_no, coalesce(cur.url_hash, old.url_hash) as url_hash, coalesce(cur.heading, old.heading) as heading,
  case when old.digest is null then 'added' when cur.digest is null then 'removed' else 'changed' end as change
from cur full join old on cur.snap_no = old.snap_no and cur.url_hash = old.url_hash and cur.heading = old.heading
where cur.digest is distinct from old.digest"""
)
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return snapshot_changes(read_table(spark, root, "section_snapshot", "snap_no", "url_hash", "heading", "body", "loaded_at"))


# ---- pages: versions, freshness, equal bodies

_KEYED = f"(select distinct page_id, created_at, ttl_ms, spa_partial, markdown, content_hash, body_hash, {S.URL_HASH} as url_hash from {S.url_parts('cached_page', keys='page_id, created_at, ttl_ms, spa_partial, markdown, content_hash, body_hash')})"
_LATEST = f"(select * from (select *, row_number() over (partition by url_hash order by created_at desc, page_id desc) as k from {_KEYED}) where k = 1)"


def _keyed(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return _saves(spark, root, "url", *columns).withColumn("url_hash", urls.url_hash("url")).drop("url")


@query(f"select url_hash, created_at, page_id, sha256(markdown) as digest from {_LATEST}")
def latest_pages(spark: SparkSession, root: str) -> DataFrame:
    return store.latest(_keyed(spark, root, "created_at", "markdown").withColumn("digest", text.body_hash("markdown")).drop("markdown"), "url_hash", "created_at", "page_id")


@query(f"select page_id, coalesce(content_hash, left(sha256(markdown), 16)) as content_hash, coalesce(body_hash, sha256(markdown)) as body_hash from {_KEYED}")
def completed_pages(spark: SparkSession, root: str) -> DataFrame:
    return pages.completed(_keyed(spark, root, "markdown", "content_hash", "body_hash")).select("page_id", "content_hash", "body_hash")


_VERSIONS = f"versions as (select url_hash, digest, created_at, page_id from (select *, lag(digest) over (partition by url_hash order by created_at, page_id) as b from (select *, sha256(markdown) as digest from {_KEYED})) where b is null or b <> digest)"


def _versions(spark: SparkSession, root: str) -> DataFrame:
    saves = _keyed(spark, root, "created_at", "markdown").withColumn("digest", text.body_hash("markdown")).drop("markdown")
    return pages.versions(saves, "url_hash", "digest", "created_at", "page_id")


@query(f"with {_VERSIONS} select * from versions")
def version_log(spark: SparkSession, root: str) -> DataFrame:
    return _versions(spark, root)


@query(
    """with v as (select user_id, (epoch_us(ts) // 1000) as t from events where event_type = 'view'), r as (select *, row_number() over (partition by user_id order by t desc) as k from v),
  g as (select user_id, t - lag(t) over (partition by user_id order by t) as gap from r where k <= 20)
select user_id, cast(case when count(*) < 3 or max(gap) <= 0 then 86400000 else least(604800000, greatest(3600000, floor(avg(case when gap > 0 then gap end) / 2 + 0.5))) end as bigint) as ttl_ms from g group by user_id"""
)
def adaptive_ttl(spark: SparkSession, root: str) -> DataFrame:
    seen = read_table(spark, root, "events", "user_id", "ts", "event_type").filter("event_type = 'view'").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return pages.adaptive_ttl(seen, "user_id", "at")


@query(
    f"""with {_VERSIONS}, r as (select v.url_hash, v.created_at as t, coalesce(p.shell, false) as shell, row_number() over (partition by v.url_hash order by v.created_at desc, v.page_id desc) as k
    from versions v join (select page_id, bool_or(coalesce(spa_partial, false)) as shell from cached_page group by page_id) p using (page_id)),
  g as (select url_hash, shell, t - lag(t) over (partition by url_hash order by t) as gap from r where k <= 20)
select url_hash, cast(case when count(*) < 3 or coalesce(max(gap), 0) <= 0 or bool_or(shell) then 86400000 else least(604800000, greatest(3600000, floor(avg(case when gap > 0 then gap end) / 2 + 0.5))) end as bigint) as ttl_ms from g group by url_hash"""
)
def page_ttl(spark: SparkSession, root: str) -> DataFrame:
    """Freshness of each page from the times of its versions; shells keep the default."""
    shells = _saves(spark, root, "spa_partial")
    return pages.adaptive_ttl(_versions(spark, root).join(shells, "page_id"), "url_hash", "created_at", shell="spa_partial")


@query(f"select url_hash, page_id, 1769650000000 - created_at < coalesce(ttl_ms, 86400000) as fresh, cast(least(604800000, floor(coalesce(ttl_ms, 86400000) * 1.6::double + 0.5)) as bigint) as lease from {_LATEST}")
def fresh_pages(spark: SparkSession, root: str) -> DataFrame:
    now = store.latest(_keyed(spark, root, "created_at", "ttl_ms"), "url_hash", "created_at", "page_id")
    return now.select("url_hash", "page_id", pages.is_fresh(F.col("created_at"), F.col("ttl_ms"), NOW).alias("fresh"), pages.grown_lease(F.col("ttl_ms")).alias("lease"))


_OWNERS = f"able as (select url_hash, sha256(markdown) as body, created_at, page_id from {_KEYED} where {S.tokens('markdown')} >= 50 and not coalesce(spa_partial, false)), owners as (select body, arg_min(url_hash, (created_at, page_id)) as owner from able group by body)"


def _shared(spark: SparkSession, root: str) -> DataFrame:
    return _keyed(spark, root, "created_at", "markdown", "spa_partial").withColumn("body_hash", text.body_hash("markdown"))


@query(f"with {_OWNERS} select body as body_hash, owner from owners")
def body_owner(spark: SparkSession, root: str) -> DataFrame:
    return pages.body_owners(_shared(spark, root), "url_hash", "created_at", "page_id")


@query(f"with {_OWNERS} select distinct url_hash, owner, body as body_hash from able join owners using (body) where url_hash <> owner")
def alias_map(spark: SparkSession, root: str) -> DataFrame:
    rows = _shared(spark, root)
    return pages.aliases(rows, pages.body_owners(rows, "url_hash", "created_at", "page_id"), "url_hash")


@query("select sha256(text) as body_hash, count(*) as pages from documents group by 1")
def equal_bodies(spark: SparkSession, root: str) -> DataFrame:
    return pages.equal_bodies(read_table(spark, root, "documents", "text"), "text")


@query(
    f"""select distinct a.url_hash, a.owner, a.at_ms from page_alias a join {_LATEST} p on p.url_hash = a.owner
where a.url_hash <> a.owner and a.body_hash = sha256(p.markdown) and 1769650000000 - p.created_at < coalesce(p.ttl_ms, 86400000) + 2592000000"""
)
def valid_alias(spark: SparkSession, root: str) -> DataFrame:
    """Aliases whose owner still has their body; freshness is judged thirty days more leniently, as these pages are old at NOW."""
    links = read_table(spark, root, "page_alias", "url_hash", "owner", "body_hash", "at_ms").filter("url_hash != owner").distinct()
    current = store.latest(_keyed(spark, root, "created_at", "ttl_ms", "markdown").withColumn("body_hash", text.body_hash("markdown")).drop("markdown"), "url_hash", "created_at", "page_id")
    return pages.valid_aliases(links, current, NOW - 30 * pages.DAY_MS).select("url_hash", "owner", "at_ms")


@query(f"select page_id, case when coalesce(spa_partial, false) then 'partial' when {S.tokens('markdown')} < 50 then 'near-empty' end as verdict from {_KEYED}")
def low_yield(spark: SparkSession, root: str) -> DataFrame:
    return _keyed(spark, root, "markdown", "spa_partial").select("page_id", pages.low_yield(text.estimate_tokens("markdown"), F.col("spa_partial")).alias("verdict"))


@query(
    """with recursive a as (select distinct url_hash, owner from page_alias where url_hash <> owner), h as (select url_hash as url, min(owner) as location from a group by url_hash),
  w(url, final_url, hops) as (select url, url, 0 from h union all select w.url, h.location, w.hops + 1 from w join h on h.url = w.final_url where w.hops < 6)
select url, arg_max(final_url, hops) as final_url, max(hops) as hops, case when max(hops) = 6 then 'too many' else 'ok' end as status from w group by url"""
)
def redirects(spark: SparkSession, root: str) -> DataFrame:
    """Aliases read as redirects."""
    hops = read_table(spark, root, "page_alias", "url_hash", "owner").filter("url_hash != owner").groupBy(F.col("url_hash").alias("url")).agg(F.min("owner").alias("location"))
    return pages.redirected(hops.select("url"), hops)


# ---- access log


@query("""select domain, cast(sum(greatest(0, coalesce(saved, 0))) as bigint) as saved
from (select distinct seq, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(domain)), '\\.+$', ''), '^www\\.', ''), ''), 'unknown') as domain, saved from activity) group by domain""")
def domain_leaderboard(spark: SparkSession, root: str) -> DataFrame:
    return stats.saved_by_site(read_table(spark, root, "activity", "seq", "domain", "saved"))


_BY_SITE = "(select domain, cast(sum(greatest(0, coalesce(saved, 0))) as bigint) as saved from (select distinct seq, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(domain)), '\\.+$', ''), '^www\\.', ''), ''), 'unknown') as domain, saved from activity) group by domain)"


@query(f"select * from {_BY_SITE} order by saved desc, domain limit 8")
def top_domains(spark: SparkSession, root: str) -> DataFrame:
    return stats.leaders(read_table(spark, root, "activity", "seq", "domain", "saved"))


@query("""select cast(coalesce(sum(greatest(0, coalesce(saved, 0))), 0) as bigint) as tokens_saved, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses,
  coalesce(count(*) filter (where hit) / nullif(count(*) filter (where hit is not null), 0)::double, 0) as hit_rate, cast(coalesce(floor(sum(greatest(0, coalesce(saved, 0))) / nullif(count(*) filter (where hit is not null), 0)::double + 0.5), 0) as bigint) as mean_saved
from (select distinct seq, saved, hit from activity)""")
def global_stats(spark: SparkSession, root: str) -> DataFrame:
    return stats.totals(read_table(spark, root, "activity", "seq", "saved", "hit"))


@query("select seq, domain, saved, hit, at_ms from (select distinct * from activity) order by seq desc limit 30")
def recent_activity(spark: SparkSession, root: str) -> DataFrame:
    return stats.recent(read_table(spark, root, "activity", "seq", "domain", "saved", "hit", "at_ms"))


@query()
def stats_json(spark: SparkSession, root: str) -> DataFrame:
    return stats.stats_json(read_table(spark, root, "activity", "seq", "domain", "saved", "hit"))


@query("select domain, seq, at_ms from (select *, row_number() over (partition by domain order by seq desc) as k from (select distinct seq, domain, at_ms from activity)) where k <= 20")
def activity_rings(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "activity", "seq", "domain", "at_ms").dropDuplicates(["seq"])
    return store.newest(rows, 20, "seq", keys=("domain",))


@query(f"select page_id, coalesce(n, 0) as n from (select distinct page_id, {S.SITE} as site from {S.url_parts('cached_page', keys='page_id')}) left join (select domain as site, count(*) as n from (select distinct seq, domain from activity) group by domain) using (site)")
def page_counters(spark: SparkSession, root: str) -> DataFrame:
    """Fetches of each page's site; 0 where there are none."""
    counts = store.counters(stats.log_once(read_table(spark, root, "activity", "seq", "domain")).withColumnRenamed("domain", "site"), "site")
    return store.read_counter(_saves(spark, root, "url").select("page_id", urls.site("url").alias("site")), counts, "site").select("page_id", "n")


@query("select distinct seq, domain, at_ms from activity where at_ms + 86400000 > 1769650000000 and domain not in (select owner from page_alias where owner is not null)")
def live_activity(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "activity", "seq", "domain", "at_ms").filter("domain is not null").dropDuplicates(["seq"])
    gone = read_table(spark, root, "page_alias", F.col("owner").alias("domain"))
    return store.delete(store.live(rows, "at_ms", pages.DAY_MS, NOW), gone, "domain")


@query(
    """with recursive e as (select seq, coalesce(domain, 'anon') as client, at_ms, row_number() over (partition by coalesce(domain, 'anon') order by at_ms, seq) as k from (select distinct seq, domain, at_ms from activity where at_ms is not null)),
  f(client, k, at_ms, seq, opened, n) as (select client, k, at_ms, seq, at_ms, 1 from e where k = 1
    union all select e.client, e.k, e.at_ms, e.seq, case when e.at_ms >= f.opened + 3600000 then e.at_ms else f.opened end, case when e.at_ms >= f.opened + 3600000 then 1 else f.n + 1 end from f join e on e.client = f.client and e.k = f.k + 1)
select client, at_ms, seq, cast(n as bigint) as n, n <= 3 as allowed from f"""
)
def request_windows(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "activity", "seq", "domain", "at_ms").dropDuplicates(["seq"]).withColumnRenamed("domain", "client")
    return windows.anchored_counts(rows, HOUR, 3)


@query()
def replay_log(spark: SparkSession, root: str) -> DataFrame:
    """Demand replayed against the cache; the origin's content is that of the page's last save, unchanged when asked an even number of times."""
    asked = demand.demand_once(read_table(spark, root, "demand_event", "seq", "url", "at_ms")).withColumn("url_hash", urls.url_hash(urls.canonical("url")["canonical_url"]))
    return replay.replay(asked.withColumn("digest", F.when(F.col("seq") % 2 == 1, F.sha2(F.floor(F.col("at_ms") / pages.DAY_MS).cast("string"), 256))))


@query(f"with once as (select distinct seq, url from demand_event) select docset, count(*) as n from (select seq, {S.DOC_SET} as docset from {S.url_parts('once', keys='seq')} where raw is not null union all select seq, 'unknown' from once where url is null) group by docset")
def demand_frequency(spark: SparkSession, root: str) -> DataFrame:
    return demand.frequency(read_table(spark, root, "demand_event", "seq", "url"))


@query(f"with once as (select distinct seq, url, at_ms from demand_event where url is not null) select docset, arg_max(raw, (at_ms, seq)) as url from (select seq, at_ms, raw, {S.DOC_SET} as docset from {S.url_parts('once', keys='seq, at_ms')}) group by docset")
def demand_samples(spark: SparkSession, root: str) -> DataFrame:
    return demand.sample_urls(read_table(spark, root, "demand_event", "seq", "url", "at_ms"))


_FIRST = f"""starts as (select distinct site, created_at as s from (select created_at, {S.SITE} as site from {S.url_parts("cached_page", keys="created_at")})),
  asked as (select distinct seq, domain as site, at_ms from demand_event where domain is not null),
  found as (select site, s as start_at, min(at_ms) as first_at from starts left join asked using (site) where at_ms > s and at_ms <= s + 86400000 group by site, s),
  lead as (select starts.site, s as start_at, first_at from starts left join found on found.site = starts.site and found.start_at = s)"""


def _first(spark: SparkSession, root: str) -> DataFrame:
    starts = read_table(spark, root, "cached_page", "url", "created_at").select(urls.site("url").alias("site"), F.col("created_at").alias("start_at"))
    asked = demand.demand_once(read_table(spark, root, "demand_event", "seq", "domain", "at_ms")).filter("domain is not null").select(F.col("domain").alias("site"), "at_ms")
    return demand.first_after(starts, asked, 24 * HOUR, "site")


@query(f"with {_FIRST} select * from lead")
def lead_time(spark: SparkSession, root: str) -> DataFrame:
    """The first demand within a day of each save, by site."""
    return _first(spark, root)


@query(
    f"""with {_FIRST}, a as (select site, count(*) as starts, count(first_at) as followed, list_sort(list(first_at - start_at) filter (where first_at is not null)) as l from lead group by site)
select site, starts, followed, followed / starts::double as share, l[least(followed, floor(50 * followed / 100)::bigint + 1)] as p50_ms, l[least(followed, floor(90 * followed / 100)::bigint + 1)] as p90_ms from a"""
)
def lead_summary(spark: SparkSession, root: str) -> DataFrame:
    return demand.lead_times(_first(spark, root), "site")


@query("select event_type, list_sort(list(value))[least(count(*), floor(90 * count(*) / 100)::bigint + 1)] as p90 from events where value is not null group by event_type")
def value_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The 90th percentile by type."""
    return demand.ranked_percentiles(read_table(spark, root, "events", "event_type", "value"), ["event_type"], "value", [90])


@query("select distinct url from demand_event where url is not null order by url limit 25")
def first_urls(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "demand_event", "url").filter("url is not null").distinct().orderBy("url").limit(25)


@query("select 'npm' as type, 'c' || o_custkey as id, (epoch_us(o_orderdate) // 1000) as at_ms from orders union all select 'pypi', 'c' || o_custkey, (epoch_us(o_orderdate) // 1000) from orders union all select 'github', 'c' || o_custkey, (epoch_us(o_orderdate) // 1000) from orders")
def feed_releases(spark: SparkSession, root: str) -> DataFrame:
    """Order dates written as the three feed formats and read back."""
    rows = read_table(spark, root, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("t"), "o_orderkey")
    npm = F.to_json(F.struct(F.create_map(F.lit("created"), F.col("t"), F.col("o_orderkey").cast("string"), F.col("t")).alias("time")))
    pypi = F.to_json(F.struct(F.create_map(F.col("o_orderkey").cast("string"), F.array(F.struct(F.col("t").alias("upload_time_iso_8601")))).alias("releases")))
    github = F.to_json(F.array(F.struct(F.col("t").alias("published_at"))))
    feeds = [rows.select(F.lit(kind).alias("type"), "id", body.alias("body")) for kind, body in (("npm", npm), ("pypi", pypi), ("github", github))]
    return release_times(feeds[0].unionByName(feeds[1]).unionByName(feeds[2]))


# ---- notes

_NOTE_LOG = "(select doc_id as seq, (epoch_us(fetched_at) // 1000) as at_ms, source as target, text, kind from documents where kind = 'note' and text is not null and source is not null)"
_NOTES = f"""notes as (select arg_min(seq, (at_ms, seq)) as note_id, 't:' || left(regexp_replace(regexp_replace(lower(target), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) as target_key,
    arg_min(left(text, 500), (at_ms, seq)) as text, arg_min(kind, (at_ms, seq)) as kind, min(at_ms) as at_ms, count(*) as votes from {_NOTE_LOG} group by 2, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))"""


def _notes(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "documents", "doc_id", "text", "source", "kind", "fetched_at").filter("kind = 'note' and text is not null and source is not null")
    log = rows.select(F.col("doc_id").alias("seq"), F.unix_millis(F.col("fetched_at").cast("timestamp")).alias("at_ms"), F.col("source").alias("target"), "text", "kind")
    return notes.merged_notes(log)


def _reactions(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "events", "user_id", "event_type").filter("event_type in ('click', 'error')")
    return notes.reactions(rows.select(F.col("user_id").alias("note_id"), F.when(F.col("event_type") == "click", "vote").otherwise("flag").alias("action")))


@query(f"with {_NOTES} select * from notes")
def note_merge(spark: SparkSession, root: str) -> DataFrame:
    return _notes(spark, root)


@query("select user_id as note_id, count(*) filter (where event_type = 'click') as votes, count(*) filter (where event_type = 'error') as flags from events where event_type in ('click', 'error') group by user_id")
def note_reactions(spark: SparkSession, root: str) -> DataFrame:
    return _reactions(spark, root)


@query(
    f"""with {_NOTES}, ring as (select * from (select *, row_number() over (partition by target_key order by at_ms desc, note_id desc) as k from notes) where k <= 50),
  c as (select user_id as note_id, count(*) filter (where event_type = 'click') as v, count(*) filter (where event_type = 'error') as f from events where event_type in ('click', 'error') group by user_id),
  l as (select ring.note_id, target_key, kind, at_ms, coalesce(v, 0) as votes, coalesce(f, 0) as flags from ring left join c using (note_id)),
  w as (select *, (votes - flags) * pow(0.5, (1769650000000 - at_ms) / 86400000 / 30) as weight from l where votes - flags > -3 and flags < 5)
select note_id, target_key, kind, at_ms, votes, flags, rank from (select *, row_number() over (partition by target_key order by weight desc, at_ms desc, note_id desc) as rank from w) where rank <= 12"""
)
def note_recall(spark: SparkSession, root: str) -> DataFrame:
    ranked = notes.ranked_notes(_notes(spark, root), _reactions(spark, root), NOW)
    return notes.recalled(ranked).select("note_id", "target_key", "kind", "at_ms", "votes", "flags", "rank")


_PINNED = f"""first as (select * from (select *, row_number() over (partition by url_hash order by created_at, page_id) as k from {_KEYED}) where k = 1),
  stale as (select 'u:' || f.url_hash as target_key, f.page_id as note_id, left(sha256(f.markdown), 16) as pin_hash, left(sha256(f.markdown), 16) <> left(sha256(l.markdown), 16) as stale from first f join {_LATEST} l using (url_hash))"""


@query(f"with {_PINNED} select target_key, note_id, pin_hash, coalesce(stale, false) as stale from stale")
def stale_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes pinned to the first save of each page, held against the last."""
    rows = _keyed(spark, root, "created_at", "markdown").withColumn("content_hash", text.content_hash("markdown")).drop("markdown")
    saves = Scratch(spark, "stale").keep(rows, "saves")
    first = store.put_if_absent(saves, "url_hash", "created_at", "page_id")
    last = store.latest(saves, "url_hash", "created_at", "page_id")
    pinned = notes.pinned(first.select(F.concat(F.lit("u:"), "url_hash").alias("target_key"), F.col("page_id").alias("note_id")), first)
    return notes.marked_stale(pinned, last)


# ---- changes since a cutoff

_MODELS = ["claude-opus-4-8", "Claude-Opus-4-20250514", "gpt-4o-mini", "gpt-4-turbo-preview", "GPT-4", "o1-preview", "llama-3-70b", "gemini-1.5-pro", "mistral-7b", "foo1bar", ""]


@query(
    "with k(model_key, cutoff) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in cutoffs.CUTOFFS.items()) + "), m(model) as (values " + ", ".join(f"('{m}')" for m in _MODELS) + """)
select model, (select cutoff from k where contains(lower(model), model_key) order by length(model_key) desc limit 1) as cutoff from m"""
)
def model_cutoff(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in _MODELS], "model string").select("model", cutoffs.cutoff_of("model").alias("cutoff"))


@query("select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in cutoffs.CUTOFFS.items()) + ") as t(model_key, cutoff)")
def cutoff_registry(spark: SparkSession, root: str) -> DataFrame:
    return cutoffs.registry(spark)


@query(f"with {_VERSIONS} select url_hash, count(*) as changes, arg_max(digest, (created_at, digest)) as latest from versions where created_at > 1768000000000 group by url_hash")
def whats_new(spark: SparkSession, root: str) -> DataFrame:
    return cutoffs.changes_since(_versions(spark, root), "url_hash", "digest", "created_at", SINCE)


# ---- answers


@query(
    f"""select page_id, '_cache ' || state || ' · ' || d || ' tokens returned vs ~' || o || ' raw · saved ~' || s || ' tokens (' || cast(case when o = 0 then 0 else floor(s * 100 / o::double + 0.5) end as bigint) || '%) · content hash ' || h ||
  case when rendered_with is not null then ' · rendered with ' || rendered_with when p then ' · partial' else '' end || '_' as footer
from (select distinct page_id, {S.tokens("markdown")} as d, coalesce(original_tokens, 0) as o, greatest(0, coalesce(original_tokens, 0) - {S.tokens("markdown")}) as s, left(sha256(markdown), 16) as h, rendered_with, coalesce(spa_partial, false) as p,
  case when 1769650000000 - created_at < coalesce(ttl_ms, 86400000) then 'hit' else 'miss' end as state from cached_page) where h is not null"""
)
def fetch_footer(spark: SparkSession, root: str) -> DataFrame:
    rows = _saves(spark, root, "markdown", "original_tokens", "rendered_with", "spa_partial", "created_at", "ttl_ms").filter("markdown is not null")
    tokens, raw = text.estimate_tokens("markdown"), F.coalesce("original_tokens", F.lit(0))
    saved = text.tokens_saved("original_tokens", tokens)
    off = F.lit(False)
    state = rendering.fetch_state(off, off, pages.is_fresh(F.col("created_at"), F.col("ttl_ms"), NOW), off, off)
    source = F.when(F.col("rendered_with").isNotNull(), F.concat(F.lit("rendered with "), "rendered_with")).when(F.coalesce("spa_partial", F.lit(False)), "partial")
    return rows.select("page_id", rendering.footer(state, tokens, raw, saved, text.percent_saved(saved, raw), text.content_hash("markdown"), source).alias("footer"))


def _canonical_sql(table: str, keys: str) -> str:
    """Rows of `table` with keys and canonical_url of web addresses."""
    return f"""(select {keys}, scheme || '://' || usr || case when bare = 'ar5iv.labs.arxiv.org' then 'ar5iv.org' else bare end || {S.PORT} || {S.NO_SLASH}
    || case when len(list_filter({_PARAMS}, lambda x: lower(split_part(x, '=', 1)) in {_TRACKED})) > 0 then case when kept <> '' then '?' || kept else '' end else query end as canonical_url
  from (select *, regexp_replace(host, '^www\\.', '') as bare, array_to_string(list_filter({_PARAMS}, lambda x: x <> '' and lower(split_part(x, '=', 1)) not in {_TRACKED}), '&') as kept from {S.url_parts(table, keys=keys)}))"""


def _requests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A request for each save's address: without a known hash, with the save's own, with the page's first, or with an unknown one; some for a section, some with a budget."""
    rows = _saves(spark, root, "url", "created_at", "markdown", "original_tokens").filter("markdown is not null").withColumn("url_hash", urls.url_hash(urls.canonical("url")["canonical_url"]))
    saves = Scratch(spark, "fetch").keep(rows.withColumn("content_hash", text.content_hash("markdown")), "saves")
    first = store.put_if_absent(saves.select("url_hash", "created_at", "page_id", "content_hash"), "url_hash", "created_at", "page_id").select("url_hash", F.col("content_hash").alias("first_hash"))
    kind = F.col("page_id") % 4
    asked = saves.join(first, "url_hash").select(
        F.col("page_id").alias("request_id"),
        "url",
        F.when(kind == 1, F.col("content_hash")).when(kind == 2, F.col("first_hash")).when(kind == 3, "unknown").alias("known_hash"),
        F.when(F.col("page_id") % 5 == 0, "rows").alias("section"),
        F.when(F.col("page_id") % 3 == 0, 200).alias("token_budget"),
    )
    current = store.latest(saves.select("url_hash", "created_at", "page_id", "markdown", "original_tokens"), "url_hash", "created_at", "page_id")
    return asked, current, saves


@query(
    f"""with {S.SECTIONS}, keyed as (select page_id, created_at, left(sha256(canonical_url), 32) as url_hash, left(sha256(markdown), 16) as h from {_canonical_sql("(select distinct page_id, created_at, url, markdown from cached_page where markdown is not null)", "page_id, created_at, markdown")}),
  latest as (select url_hash, arg_max(page_id, (created_at, page_id)) as current, arg_min(h, (created_at, page_id)) as first_hash from keyed group by url_hash),
  req as (select k.page_id as request_id, k.url_hash, l.current, c.h as content_hash, case k.page_id % 4 when 1 then k.h when 2 then l.first_hash when 3 then 'unknown' end as known_hash, k.page_id % 5 = 0 as sectioned
    from keyed k join latest l using (url_hash) join keyed c on c.page_id = l.current),
  prior as (select url_hash, h, min(page_id) as prior from keyed group by url_hash, h),
  st as (select r.*, p.prior, case when known_hash is not distinct from content_hash then 'unchanged' when p.prior is not null and not sectioned then 'delta'
    when sectioned and exists (select 1 from sections s where s.page_id = r.current and contains(lower(s.heading), 'rows')) then 'section' else 'page' end as state from req r left join prior p on p.url_hash = r.url_hash and p.h = r.known_hash),
  old as (select st.request_id, lower(s.heading) as name, arg_max(s.sha256, s.pos) as sha256 from st join sections s on s.page_id = st.prior where state = 'delta' group by 1, 2),
  n as (select st.request_id, count(*) as total, count(*) filter (where old.sha256 is null or old.sha256 <> s.sha256) as changed from st join sections s on s.page_id = st.current left join old on old.request_id = st.request_id and old.name = lower(s.heading) where state = 'delta' group by 1)
select st.request_id, state, content_hash, n.changed as sections_changed, n.total as sections_total from st left join n using (request_id)"""
)
def fetch_states(spark: SparkSession, root: str) -> DataFrame:
    return answers.fetch_view(*_requests(spark, root)).select("request_id", "state", "content_hash", "sections_changed", "sections_total")


@query()
def fetch_answers(spark: SparkSession, root: str) -> DataFrame:
    return answers.fetch_view(*_requests(spark, root))


# ---- streams


def _as_stream(spark: SparkSession, path: str, schema, transform, mode: str, label: str) -> DataFrame:
    """What a stream over a folder of files gives once it has read them all: its last table in mode complete, all rows in mode append."""
    scratch = Scratch(spark, label)
    kept: list[DataFrame] = []

    def keep(batch: DataFrame, number: int) -> None:
        kept.append(scratch.keep(batch, f"batch{number}"))

    out = transform(spark.readStream.schema(schema).parquet(path))
    run = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch.path("state")).trigger(availableNow=True).start()
    run.awaitTermination()
    if not kept:
        return spark.createDataFrame([], out.schema)
    return kept[-1] if mode == "complete" else functools.reduce(DataFrame.unionByName, kept)


@query("select domain, cast(sum(greatest(0, coalesce(saved, 0))) as bigint) as saved, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses from activity group by domain")
def stream_totals(spark: SparkSession, root: str) -> DataFrame:
    """Running totals of the activity table read as a stream, as they stand when it has been read.

    Deliveries are counted, as in its SQL: a row delivered twice counts twice, unlike in `domain_leaderboard` and `global_stats`.
    """
    path = f"{root}/activity.parque[t]"  # a pattern, as a stream's source may be a folder or a file
    return _as_stream(spark, path, read_table(spark, root, "activity").schema, folds.running_totals, "complete", "stream")


@query(ORACLE["request_windows"])
def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """The requests of `request_windows` as a stream: each client's come in order, and its open window is kept as state."""
    rows = read_table(spark, root, "activity", "seq", "domain", "at_ms").dropDuplicates(["seq"]).filter("at_ms is not null")
    requests = rows.select(F.coalesce("domain", F.lit("anon")).alias("client"), "at_ms", "seq")
    arrived = Scratch(spark, "requests")
    schema = arrived.keep(requests.repartition("client").sortWithinPartitions("client", "at_ms", "seq"), "arrived").schema
    with folds.state_store(spark):
        return _as_stream(spark, arrived.path("arrived"), schema, lambda df: folds.anchored_counts(df, HOUR, 3), "append", "windows")


from tidemark.plans import replies  # noqa: E402, F401  (registers its queries)
