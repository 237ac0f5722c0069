"""Text functions: sizes, digests, clipping and note text.

Lengths are UTF-16 code units throughout, and white space is the set that ECMAScript's \\s and trim() use, so results agree
with a store that was filled by a JavaScript service.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: ECMAScript white space and line ends, as the inside of a character class.
BLANKS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: Note text that reads like an attempt to steer the reader (fixed values).
STEERING = (
    r"(?i)\b(?:ignore (?:all|the|previous|above)|disregard (?:all|the|previous)|system prompt|you are now|new instructions?"
    r"|act as|jailbreak|developer mode|override (?:your|the) (?:instructions|rules))\b"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_units(text: Column | str) -> Column:
    """Length in UTF-16 code units; null for null."""
    return (F.length(F.encode(_col(text), "UTF-16BE")) / 2).cast("long")


def estimate_tokens(text: Column | str) -> Column:
    """A token for four code units, rounded up; 0 for a null or empty text."""
    return F.coalesce(F.ceil(utf16_units(text) / 4), F.lit(0)).cast("long")


def body_hash(text: Column | str) -> Column:
    """Full SHA-256 of the text in hex: the key of equal bodies."""
    return F.sha2(_col(text), 256)


def content_hash(text: Column | str) -> Column:
    """The first 16 hex digits of the body hash, for display."""
    return F.substring(body_hash(text), 1, 16)


def trimmed(text: Column | str) -> Column:
    """Without white space at both ends, by ECMAScript's set."""
    return F.regexp_replace(_col(text), rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def tokens_saved(original: Column | str, distilled: Column | str) -> Column:
    """What a fetch saved; never negative, a null counts as 0."""
    zero = F.lit(0).cast("long")
    return F.greatest(zero, F.coalesce(_col(original), zero) - F.coalesce(_col(distilled), zero))


def percent_saved(saved: Column | str, original: Column | str) -> Column:
    """Whole percent, halves up; 0 where nothing was fetched."""
    return F.coalesce(F.floor(F.try_divide(_col(saved) * 100, _col(original)) + 0.5), F.lit(0)).cast("long")


def dedup_form(text: Column | str) -> Column:
    """Lower case, everything but a-z and 0-9 as single blanks. Texts without such letters all have the empty form."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column | str) -> Column:
    """Unicode NFC. Plain ASCII and Latin-1 are composed already and don't leave the JVM."""
    c = _col(text)
    return F.when(c.rlike("[^\\x00-\\xff]"), _nfc(F.when(c.rlike("[^\\x00-\\xff]"), c))).otherwise(c)


def clean_note(text: Column | str, limit: int = 500) -> Column:
    """One safe line: NFC, control characters as blanks, backticks as ', no angle brackets, single blanks, at most `limit` characters."""
    t = F.regexp_replace(composed(text), r"[\x00-\x1f\x7f]", " ")
    t = F.regexp_replace(F.regexp_replace(t, "`+", "'"), "[<>]", "")
    return F.substring(trimmed(F.regexp_replace(t, rf"[{BLANKS}]+", " ")), 1, limit)


def is_steering(text: Column | str) -> Column:
    """Whether a note reads like an attempt to steer its reader; false for null."""
    return F.coalesce(_col(text).rlike(STEERING), F.lit(False))


def clip_to_budget(text: Column | str, budget: Column | int | None, marker: str = "_[clipped to ~{} tokens]_") -> Column:
    """The text if it fits into `budget` tokens; otherwise its first 4 * budget units, cut back to the last blank line if that
    lies beyond their middle, trimmed, and a marker. A null or 0 budget clips nothing. A character that the limit would cut
    in two is left out.
    """
    c = _col(text)
    n = budget if isinstance(budget, Column) else F.lit(budget).cast("long")
    limit = n * 4
    # where every character is one unit, characters count; otherwise the prefix is taken in units and a half character dropped
    plain = F.substring(c, F.lit(1), limit.cast("int"))
    wide = F.decode(F.substring(F.encode(c, "UTF-16BE"), F.lit(1), (limit * 2).cast("int")), "UTF-16BE")
    split = F.conv(F.hex(F.substring(F.encode(c, "UTF-16BE"), (limit * 2 - 1).cast("int"), F.lit(2))), 16, 10).cast("int").between(0xD800, 0xDBFF)
    whole = F.when(split, F.decode(F.substring(F.encode(c, "UTF-16BE"), F.lit(1), (limit * 2 - 2).cast("int")), "UTF-16BE")).otherwise(wide)
    head = F.when(F.length(c) == utf16_units(c), plain).otherwise(whole)
    tail = F.substring_index(head, "\n\n", -1)
    last = utf16_units(head) - utf16_units(tail) - 2
    cut = F.when((F.instr(head, "\n\n") > 0) & (last > limit / 2), F.substring(head, F.lit(1), F.length(head) - F.length(tail) - 2))
    before, _, after = marker.partition("{}")
    short = F.concat(trimmed(F.coalesce(cut, head)), F.lit("\n\n" + before), n.cast("string"), F.lit(after))
    return F.when(n.isNull() | (n == 0) | (estimate_tokens(c) <= n), c).otherwise(short)


def relative_age(at: Column | str, now: int) -> Column:
    """`5s`, `3m` or `2h` ago, from milliseconds."""
    seconds = F.floor((F.lit(now) - _col(at)) / 1000)
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h")))


def parsed_json(text: Column | str, schema: str) -> Column:
    """The value, or null where the text isn't JSON of that schema."""
    return F.from_json(_col(text), schema, {"mode": "PERMISSIVE"})


def window_hours(spec: str, default: int = 24) -> int:
    """Hours of `24h` or `7d`; the default for anything else."""
    number, unit = spec[:-1], spec[-1:]
    return int(number) * (24 if unit == "d" else 1) if unit in ("h", "d") and number.isascii() and number.isdigit() else default


def spec_hours(spec: Column | str, default: int = 24) -> Column:
    """window_hours of a column; the default for a null too."""
    number = F.regexp_extract(_col(spec), "^([0-9]{1,6})[hd]$", 1)
    hours = F.when(number != "", number.cast("int") * F.when(_col(spec).endswith("d"), 24).otherwise(1))
    return F.coalesce(hours, F.lit(default)).cast("int")


def lossy_utf8(data: Column | str) -> Column:
    """Text of bytes; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(_col(data).cast("string"))
