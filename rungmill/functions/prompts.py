"""Lists of prompts in generated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungmill.functions.text import strip

NUMBER = r"(?U)^\d+[.)]\s*"
LEAST_CHARS = 15


def prompt_list(raw: Column, n: int) -> Column:
    """The first n prompts of a list: one to a line, a leading number removed, of more than 15 characters.

    The whole text is stripped, then a number that starts a line is removed, then the line is stripped, so an indented number
    stays. n below 1 counts as 1. Null gives null, a text without prompts an empty array.
    """
    lines = F.split(strip(raw), "\n")
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, NUMBER, "")))
    return F.slice(F.filter(bare, lambda x: F.char_length(x) > LEAST_CHARS), 1, max(1, n))
