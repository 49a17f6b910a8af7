"""Column expressions for text: normalisation pieces and token helpers.

All of them are built-in Spark SQL functions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkvox.functions.lexicon import (
    CAPITALISED,
    DELIMITER,
    REPLACED_CHARS,
    STRIP_CHARS,
)


def replace_special_spaces(c: Column) -> Column:
    """Ideographic space, 0x1D, tab and CR become a plain space."""
    return F.translate(c, REPLACED_CHARS, " " * len(REPLACED_CHARS))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def strip_whitespace(c: Column) -> Column:
    """Remove leading/trailing whitespace (the full Unicode class); btrim
    only touches the ends of the string instead of scanning all of it."""
    return F.btrim(c, F.lit(STRIP_CHARS))


def take_chars(c: Column, n: int | None) -> Column:
    """First ``n`` characters, or the column unchanged when ``n`` is None."""
    return c if n is None else F.substring(c, 1, n)


def is_capitalised(c: Column) -> Column:
    return F.coalesce(c.rlike(CAPITALISED), F.lit(False))


def join_with_delimiter(arr: Column) -> Column:
    """Lemmas joined with 0x1D plus a trailing delimiter."""
    return F.concat(F.array_join(arr, DELIMITER), F.lit(DELIMITER))


def split_by_delimiter(c: Column) -> Column:
    """Tokens of a delimited string: each non-empty run before a delimiter."""
    return F.regexp_extract_all(c, F.lit(f"([^{DELIMITER}]+?){DELIMITER}"), 1)
