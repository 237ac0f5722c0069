"""URL functions in Catalyst. Addresses are cut by one pattern, since the builtin parser refuses hosts and paths that browsers accept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Query parameters that only track, and hosts that serve another host's pages.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "_ga", "yclid", "msclkid", "ref_src",
]
MIRRORS = {"ar5iv.labs.arxiv.org": "ar5iv.org"}

_PARTS = r"^[\x00-\x20]*([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#\\]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Address:
    """Parts of an address as a browser sees them: raw, scheme, user, host, port, path, query, special, valid.

    `valid` is false where there is no scheme, or no host in a scheme that needs one. A null address isn't valid.
    """

    def __init__(self, parts: Column) -> None:
        for name in ("raw", "scheme", "user", "host", "port", "path", "query", "special", "valid"):
            setattr(self, name, parts[name])

    def text(self, host: Column | None = None, path: Column | None = None, query: Column | None = None) -> Column:
        """The address without its fragment, with parts replaced."""
        host = self.host if host is None else host
        slashes = F.when(self.special | (host != ""), F.lit("//")).otherwise(F.lit(""))
        port = F.when(self.port == "", F.lit("")).otherwise(F.concat(F.lit(":"), self.port))
        return F.concat(self.scheme, F.lit(":"), slashes, self.user, host, port, self.path if path is None else path, self.query if query is None else query)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def with_address(url: Column | str, f: Callable[[Address], Column]) -> Column:
    """f of the parts of an address. The parts are computed once a row, in two steps, so the patterns don't run again for each use."""

    def cut(raw: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\r\n]", "")
        return _bound(
            clean,
            lambda t: F.struct(
                raw.alias("raw"), F.lower(F.regexp_extract(t, _PARTS, 1)).alias("scheme"), F.regexp_extract(t, _PARTS, 2).alias("authority"), F.regexp_extract(t, _PARTS, 3).alias("path"),
                F.regexp_extract(t, _PARTS, 4).alias("query"), F.coalesce(t.rlike(_PARTS), F.lit(False)).alias("matches"),
            ),
        )

    def name(s: Column) -> Column:
        place = F.lower(F.regexp_replace(s["authority"], r"^.*@", ""))
        special = F.coalesce(s["scheme"].isin(*_DEFAULT_PORT), F.lit(False))
        return F.struct(
            s["raw"].alias("raw"), s["scheme"].alias("scheme"), F.regexp_extract(s["authority"], r"^(.*@)", 1).alias("user"), place.alias("place"), F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1).alias("host"),
            F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):([0-9]*)$", 1).alias("port"), F.translate(F.replace(s["path"], F.lit(" "), F.lit("%20")), "\\", "/").alias("path"),
            F.regexp_replace(F.replace(s["query"], F.lit(" "), F.lit("%20")), r"^\?$", "").alias("query"), special.alias("special"), s["matches"].alias("matches"),
        )

    def judge(p: Column) -> Column:
        bad_host = p["host"].rlike(r"[\s<>^|%]") & ~p["host"].startswith("[")
        default = F.coalesce(F.create_map(*(F.lit(x) for kv in _DEFAULT_PORT.items() for x in kv))[p["scheme"]], F.lit(""))
        valid = p["matches"] & (~p["special"] | ((p["host"] != "") & ~bad_host & ~p["place"].rlike(r"^[^\[:]*:[^0-9]")))
        return F.struct(
            p["raw"].alias("raw"), p["scheme"].alias("scheme"), p["user"].alias("user"), p["host"].alias("host"), F.when(p["port"] == default, F.lit("")).otherwise(p["port"]).alias("port"),
            F.when(p["special"] & (p["path"] == ""), F.lit("/")).otherwise(p["path"]).alias("path"), p["query"].alias("query"), p["special"].alias("special"), F.coalesce(valid, F.lit(False)).alias("valid"),
        )

    return _bound(_bound(_bound(_bound(_col(url), cut), name), judge), lambda x: f(Address(x)))


def _without_slash(path: Column) -> Column:
    return F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, r"/\z", "")).otherwise(path)


def normal_url(url: Column | str) -> Column:
    """Without fragment and one closing slash; what isn't an address only trimmed."""
    return with_address(url, lambda a: F.when(a.valid, a.text(path=_without_slash(a.path))).otherwise(F.regexp_replace(a.raw, r"^\s+|\s+\z", "")))


def url_hash(url: Column | str) -> Column:
    """The key of a page: 32 hex digits of the SHA-256 of its normal address; null for null."""
    return F.substring(F.sha2(normal_url(url), 256), 1, 32)


def _site(a: Address) -> Column:
    return F.when(a.valid, F.regexp_replace(a.host, r"^www\.", "")).otherwise(F.lit("unknown"))


def site(url: Column | str) -> Column:
    """Host without a leading `www.`; `unknown` for null and what isn't an address."""
    return with_address(url, _site)


def doc_set(url: Column | str) -> Column:
    """Site and the first segment of the path, or the site alone."""
    first = "^/*([^/]+)"
    return with_address(url, lambda a: F.when(a.valid & a.path.rlike(first), F.concat(_site(a), F.lit("/"), F.regexp_extract(a.path, first, 1))).otherwise(_site(a)))


def canonical(url: Column | str) -> Column:
    """struct<canonical_url, kind>: kind is `raw`, `normalized` or `mirror`.

    Of http and https addresses: host in lower case without `www.`, no fragment, no tracking parameters, no closing slash, and
    the original host of a known mirror. Anything else stays as it is, as `raw`. Parameters are kept as they are written.
    """
    mirrors = F.create_map(*(F.lit(x) for kv in MIRRORS.items() for x in kv))

    def tracks(parameter: Column) -> Column:
        return F.lower(F.substring_index(parameter, "=", 1)).isin(*TRACKING)

    def made(a: Address) -> Column:
        parameters = F.split(F.regexp_replace(a.query, r"^\?", ""), "&")
        kept = F.array_join(F.filter(parameters, lambda p: (p != "") & ~tracks(p)), "&")
        query = F.when(F.exists(parameters, tracks), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))).otherwise(a.query)
        host = F.regexp_replace(a.host, r"^www\.", "")
        web = a.valid & a.scheme.isin("http", "https")
        parts = F.struct(web.alias("web"), a.raw.alias("raw"), mirrors[host].isNotNull().alias("mirror"), F.when(web, a.text(host=F.coalesce(mirrors[host], host), path=_without_slash(a.path), query=query)).otherwise(a.raw).alias("made"))
        kind = lambda p: F.when(~p["web"], "raw").when(p["mirror"], "mirror").when(p["made"] == p["raw"], "raw").otherwise("normalized")
        return _bound(parts, lambda p: F.struct(p["made"].alias("canonical_url"), kind(p).alias("kind")))

    return with_address(url, made)


def target_key(target: Column | str) -> Column:
    """Key of what a note is on: `u:` and the page key of an address, else `t:` and a slug of at most 80 letters."""
    t = F.regexp_replace(_col(target), r"^\s+|\s+\z", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), r"^-+|-+\z", ""), 1, 80)
    return F.when(t.rlike("(?i)^https?://"), F.concat(F.lit("u:"), url_hash(t))).otherwise(F.concat(F.lit("t:"), slug))


def client_key(forwarded: Column | str, session: Column | str) -> Column:
    """First hop of a forwarding header, else the session, else `anon`."""
    hop = F.regexp_replace(F.substring_index(_col(forwarded), ",", 1), r"^\s+|\s+\z", "")
    return F.coalesce(F.when(_col(forwarded) != "", hop), F.when(_col(session) != "", F.concat(F.lit("s:"), _col(session))), F.lit("anon"))
