"""Text normalisation and the optional corpus cap (group B)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvox.functions import text as T


def normalize_column(
    c: Column,
    max_process_chars: int | None = None,
    max_store_chars: int | None = None,
) -> Column:
    """Default cleaning in its exact order: (optional) first N characters →
    special spaces to space → collapse runs of spaces → strip → (optional)
    first M characters. NULL becomes "".

    The character caps are single-machine limits; they are off by default so
    whole texts are processed. Pass ``MAX_CHARS_TO_PROCESS`` /
    ``MAX_CHARS_TO_STORE`` to reproduce them.
    """
    out = T.take_chars(c, max_process_chars)
    out = T.strip_whitespace(T.collapse_spaces(T.replace_special_spaces(out)))
    out = T.take_chars(out, max_store_chars)
    return F.coalesce(out, F.lit(""))


def normalize_text(
    df: DataFrame,
    text_col: str = "text",
    custom: Callable[[Column], Column] | None = None,
    max_process_chars: int | None = None,
    max_store_chars: int | None = None,
) -> DataFrame:
    """Replace ``text_col`` by its cleaned form.

    ``custom`` replaces the default cleaning entirely (no caps then); it can
    be any Column function, including a pandas UDF.
    """
    if custom is not None:
        cleaned = custom(F.col(text_col))
    else:
        cleaned = normalize_column(F.col(text_col), max_process_chars, max_store_chars)
    return df.withColumn(text_col, cleaned)


def cap_corpus(df: DataFrame, n: int | None = None, order_col: str = "doc_id") -> DataFrame:
    """Keep the first ``n`` documents by ``order_col``; no-op when n is None."""
    if n is None:
        return df
    if n < 0:
        raise ValueError("n must be >= 0")
    return df.orderBy(order_col).limit(n)
