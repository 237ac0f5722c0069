"""Tests of network addresses and of responses, as column expressions."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, functions as F

from tidemark.functions.urls import with_address

# Private and reserved IPv4 ranges, types of responses that hold text.
PRIVATE = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4",
]
TEXT_TYPES = ["text/html", "application/xhtml", "text/plain", "application/xml", "text/xml"]
MAX_BYTES = 3_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ipv4_number(ip: Column | str) -> Column:
    """The address as a number; null for what isn't dotted IPv4."""
    parts = F.split(_col(ip), r"\.")
    ok = _col(ip).rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.try_cast("long"))
    return F.when(ok, number)


def in_range(number: Column, cidr: str) -> Column:
    """Whether an address lies in a range."""
    net = ipaddress.ip_network(cidr)
    return number.between(int(net.network_address), int(net.broadcast_address))


def is_private(ip: Column | str) -> Column:
    """Private or reserved: the IPv4 ranges; of IPv6 loopback, unspecified, unique-local, link-local and mapped IPv4, in either notation. False for null and for names."""
    c = F.regexp_replace(F.lower(_col(ip)), r"^\[|\]$", "")
    mapped = F.regexp_extract(c, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    high, low = (F.conv(F.regexp_extract(c, r"^::ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})$", k), 16, 10).cast("long") for k in (1, 2))
    number = F.coalesce(ipv4_number(c), ipv4_number(mapped), F.when(c.rlike(r"^::ffff:[0-9a-f]{1,4}:[0-9a-f]{1,4}$"), high * 65536 + low))
    v4 = F.exists(F.array(number), lambda n: reduce(lambda found, cidr: found | in_range(n, cidr), PRIVATE, F.lit(False)))  # the number is bound once
    v6 = c.isin("::1", "::") | (F.instr(c, ":").cast("boolean") & c.rlike("^(?:f[cd]|fe[89ab])"))
    return F.coalesce(v4, F.lit(False)) | F.coalesce(v6, F.lit(False))


def is_internal_host(host: Column | str) -> Column:
    c = F.lower(_col(host))
    return F.coalesce((c == "localhost") | c.endswith(".local") | c.endswith(".internal"), F.lit(False))


def refusal(url: Column | str) -> Column:
    """Why an address may not be fetched: `invalid`, `scheme`, `internal` or `private`; null where it may. Names aren't resolved."""
    return with_address(url, lambda a: F.when(~a.valid, "invalid").when(~a.scheme.isin("http", "https"), "scheme").when(is_internal_host(a.host), "internal").when(is_private(a.host), "private"))


def is_text_type(content_type: Column | str) -> Column:
    """Whether a response is text; a missing type is taken for text."""
    low = F.lower(_col(content_type))
    found = F.lit(False)
    for kind in TEXT_TYPES:
        found = found | low.contains(kind)
    return F.coalesce(found | (low == ""), F.lit(True))


def within_bytes(html: Column | str, limit: int = MAX_BYTES) -> Column:
    return F.coalesce(F.octet_length(_col(html)) <= limit, F.lit(True))
