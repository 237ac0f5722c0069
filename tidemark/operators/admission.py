"""Which arguments and notes are let in, told as columns: null where one is, else what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.text import clean_note, is_steering, utf16_units

# Ranges of numbers, and of lengths in UTF-16 code units, both ends included; which arguments may be left out.
NUMBERS = {"token_budget": (1, 100_000)}
LENGTHS = {"known_hash": (0, 64), "section": (0, 200), "target": (2, 500), "text": (3, 1000), "note_id": (4, 16)}
OPTIONAL = {"token_budget", "known_hash", "section"}
KINDS = ("gotcha", "correction", "tip")
LEAST_NOTE = 8


def argument_error(name: str, value: Column | str) -> Column:
    """`name: 7 is outside 1..5`, `name: length 7 is outside 1..5`, or `name: missing`; null for a value in range."""
    c = F.col(value) if isinstance(value, str) else value
    low, high = NUMBERS.get(name) or LENGTHS[name]
    size = c if name in NUMBERS else utf16_units(c)
    what = f"{name}: " if name in NUMBERS else f"{name}: length "
    missing = F.lit(None).cast("string") if name in OPTIONAL else F.lit(f"{name}: missing")
    return F.when(c.isNull(), missing).when(~size.between(low, high), F.concat(F.lit(what), size.cast("string"), F.lit(f" is outside {low}..{high}")))


def kind_of(kind: Column | str) -> Column:
    """A note's kind: the first one where none is given; null for one that isn't known."""
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.when(c.isNull(), KINDS[0]).when(c.isin(*KINDS), c)


def note_refusal(text: Column | str) -> Column:
    """Why a note isn't taken: `missing`, `steering`, or `short` once it is cleaned; null where it is."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.isNull(), "missing").when(is_steering(c), "steering").when(utf16_units(clean_note(c)) < LEAST_NOTE, "short")
