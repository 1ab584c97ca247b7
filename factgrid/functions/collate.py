"""Order and equality of strings as readers of a language expect them, by Spark's collations (the root locale's)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base letters first, then accents, then case (small letters first); and the same without case; and letters alone.
ORDER, CASELESS, LETTERS = "UNICODE", "UNICODE_CI", "UNICODE_CI_AI"


def ordered(column: Column | str) -> Column:
    """The column for sort, min and max: `é` stands between `e` and `f`, and `a` before `B`."""
    return F.collate(column, ORDER)


def caseless(column: Column | str) -> Column:
    """The column for joins and groups that don't tell case apart."""
    return F.collate(column, CASELESS)


def plain(column: Column | str) -> Column:
    """The column compared by its bytes again; what it holds is the same."""
    return F.collate(column, "UTF8_BINARY")
