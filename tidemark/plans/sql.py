"""Pieces of the checking SQL that several queries share. The dialect is DuckDB's; its patterns know neither lookaround nor backreferences."""

from __future__ import annotations

ASTRAL = r"[\x{10000}-\x{10FFFF}]"
BLANKS = r"\t\n\x{0B}\x{0C}\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def units(text: str) -> str:
    return f"(length({text}) + length(regexp_replace({text}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(text: str) -> str:
    return f"cast(coalesce(ceil({units(text)} / 4.0), 0) as bigint)"


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def url_parts(table: str, url: str = "url", keys: str = "") -> str:
    """A subquery with the parts of an address in `table`: scheme, host, port, path, query, valid, raw."""
    keys = f"{keys}, " if keys else ""
    pattern = r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#\\]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    return f"""(select *, scheme in ('http', 'https', 'ftp', 'ws', 'wss') as special,
      regexp_matches(trimmed, '{pattern}') and (scheme not in ('http', 'https', 'ftp', 'ws', 'wss') or (host <> '' and not (regexp_matches(host, '[\\s<>^|%]') and host not like '[%') and not regexp_matches(place, '^[^\\[:]*:[^0-9]'))) as valid,
      case when scheme in ('http', 'https', 'ftp', 'ws', 'wss') and path0 = '' then '/' else path0 end as path,
      case when port0 = (case scheme when 'http' then '80' when 'https' then '443' when 'ftp' then '21' when 'ws' then '80' when 'wss' then '443' else '' end) then '' else port0 end as port
    from (select *, lower(regexp_extract(trimmed, '{pattern}', 1)) as scheme, regexp_extract(authority, '^(.*@)', 1) as usr, regexp_extract(place, '^(\\[[^\\]]*\\]|[^:]*)', 1) as host,
      regexp_extract(place, '^(?:\\[[^\\]]*\\]|[^:]*):([0-9]*)$', 1) as port0, replace(replace(regexp_extract(trimmed, '{pattern}', 3), ' ', '%20'), '\\', '/') as path0,
      regexp_replace(replace(regexp_extract(trimmed, '{pattern}', 4), ' ', '%20'), '^\\?$', '') as query
    from (select *, lower(regexp_replace(authority, '^.*@', '')) as place
    from (select *, regexp_extract(trimmed, '{pattern}', 2) as authority
    from (select {keys}{url} as raw, regexp_replace(regexp_replace({url}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\t\\r\\n]', '', 'g') as trimmed from {table})))))"""


NO_SLASH = "case when length(path) > 1 and path like '%/' then left(path, length(path) - 1) else path end"
PORT = "case when port = '' then '' else ':' || port end"
NORMAL = f"case when valid then scheme || ':' || case when special or host <> '' then '//' else '' end || usr || host || {PORT} || {NO_SLASH} || query else trim(raw) end"
URL_HASH = f"left(sha256({NORMAL}), 32)"
SITE = "case when valid then regexp_replace(host, '^www\\.', '') else 'unknown' end"
DOC_SET = f"case when valid and regexp_extract(path, '^/*([^/]+)', 1) <> '' then {SITE} || '/' || regexp_extract(path, '^/*([^/]+)', 1) else {SITE} end"

#: Sections of cached_page as rows (page_id, url, created_at, pos, heading, level, body, sha256, tokens).
SECTIONS = f"""pages0 as (select distinct page_id, url, created_at, markdown from cached_page where markdown is not null),
  lines0 as (select page_id, url, created_at, unnest(string_split(markdown, chr(10))) as line, unnest(range(len(string_split(markdown, chr(10))))) as n from pages0),
  marked0 as (select *, regexp_matches(line, '^#{{1,6}}[{BLANKS}]+[^\\n\\r\\x{{2028}}\\x{{2029}}]*$') as head from lines0),
  numbered0 as (select *, sum(case when head then 1 else 0 end) over (partition by page_id order by n) as k from marked0),
  joined0 as (select page_id, url, created_at, k, string_agg(line, chr(10) order by n) || chr(10) as body, arg_min(line, n) as first, bool_or(head) as headed, count(*) over (partition by page_id) as parts
    from numbered0 group by page_id, url, created_at, k),
  kept0 as (select *, row_number() over (partition by page_id order by k) - 1 as pos from joined0 where headed or parts = 1 or {trim("body")} <> ''),
  sections as (select page_id, url, created_at, cast(pos as int) as pos, case when headed then {trim("regexp_replace(first, '^#{1,6}', '')")} else '(intro)' end as heading,
    case when headed then cast(length(regexp_extract(first, '^(#{{1,6}})', 1)) as int) else 0 end as level, body, sha256(body) as sha256, {tokens("body")} as tokens from kept0)"""
