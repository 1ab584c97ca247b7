"""Column functions over source text. Offsets are code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Lines of a text; a break at the end starts no line, and an empty text has none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).when(text.endswith("\n"), breaks).otherwise(breaks + 1).cast("long")


def word_count(text: Column) -> Column:
    """Words between white space of any script; the byte order mark is white space too."""
    return F.size(F.filter(F.split(text, "(?U)[\\s\\x{FEFF}]+"), lambda w: w != "")).cast("long")


def line_of(text: Column, offset: Column) -> Column:
    """The line (from 1) on which an offset (from 0) lies."""
    before = F.substring(text, F.lit(1), offset)
    return (1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def identifier_words(name: Column) -> Column:
    """The words of an identifier in camel or snake case, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with {{key}} replaced by the values, in one pass: what a value brings in stays as it is, as do unknown keys."""
    parts = re.split(r"(\{\{\w+\}\})", template)
    known = {"{{" + key + "}}": F.coalesce(value.cast("string"), F.lit("")) for key, value in values.items()}
    return F.concat(*[known.get(part, F.lit(part)) for part in parts])


def ratchet(words: Column, slack: float = 1.05) -> Column:
    """The largest ceiling that still counts as tight: the words times the slack, rounded up."""
    return F.ceil(words * F.lit(slack)).cast("long")


def pixels(token: Column) -> Column:
    """A theme value in rem (of 16 pixels) or px as whole pixels, null for other units."""
    number = F.regexp_extract(token, "^\\s*([0-9]*\\.?[0-9]+)\\s*(rem|px)\\s*$", 1)
    unit = F.regexp_extract(token, "^\\s*([0-9]*\\.?[0-9]+)\\s*(rem|px)\\s*$", 2)
    return F.when(unit == "rem", F.round(number.try_cast("double") * 16).cast("int")).when(unit == "px", F.round(number.try_cast("double")).cast("int"))
