"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a longest run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def letters_digits(c: Column) -> Column:
    """The letters and digits of a text alone, in lower case; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def words(c: Column) -> Column:
    """The words of a text in order, in lower case; null stays null, a text without words gives an empty array."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any script removed at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
