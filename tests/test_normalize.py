"""mini_texts: cleaning rules, caps and edge characters (FIXTURES §3)."""

import re

from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.operators.columns import unique_column_names
from sparkvox.operators.normalize import normalize_text

import pytest


def python_clean(text, max_process=None, max_store=None):
    """Hand-written statement of the rule, in its exact order."""
    if not isinstance(text, str):
        return ""
    t = text if max_process is None else text[:max_process]
    for ch in "　\u001d\t\r":
        t = t.replace(ch, " ")
    t = re.sub(" +", " ", t).strip()
    return t if max_store is None else t[:max_store]


MINI_TEXTS = [
    None,
    "",
    "    ",
    "a\tb\rc\nd　e\u001df\u001fg h",
    "  emoji 😀  x  ",
    "\u001f lead and trail   ",
    "x" * 1199, "x" * 1200, "x" * 1201,
    "y" * 1999, "y" * 2000, "y" * 2001,
    "z" * 1199 + " tail",          # the 1200-char cut lands on a space
    " " * 5 + "w" * 2000,          # leading spaces count toward the 2000
]


@pytest.mark.parametrize("caps", [(None, None), (L.MAX_CHARS_TO_PROCESS, L.MAX_CHARS_TO_STORE)])
def test_normalize_matches_rule(spark, caps):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MINI_TEXTS)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in normalize_text(df, max_process_chars=caps[0], max_store_chars=caps[1]).collect()}
    for i, t in enumerate(MINI_TEXTS):
        assert out[i] == python_clean(t, *caps), i


def test_newline_is_kept(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert normalize_text(df).first().text == "a\nb"


def test_custom_hook_replaces_default(spark):
    df = spark.createDataFrame([(1, "  A\tB  ")], "doc_id long, text string")
    assert normalize_text(df, custom=F.lower).first().text == "  a\tb  "


def test_unique_column_names():
    assert unique_column_names(["a", "b", "a"]) == ["a_00", "b", "a_02"]
    assert unique_column_names(["a", "A"]) == ["a_00", "A_01"]
    assert unique_column_names(["a", "A"], case_sensitive=True) == ["a", "A"]
    with pytest.raises(ValueError):
        unique_column_names(["a", "a", "a_00"])


def test_roles_and_wide_columns(spark):
    from sparkvox.operators import columns as COL
    from sparkvox.operators import wordstats as WS

    df = spark.createDataFrame([(1, "x", "2024-01-01")], "doc_id long, a string, d string")
    tagged = COL.column_roles(df, {"d": {"is_date"}, "a": {"is_label", "is_train_data"}})
    assert COL.columns_with_role(tagged, "is_date") == ["d"]
    assert COL.columns_with_role(tagged, "is_train_data") == ["a"]
    with pytest.raises(ValueError):
        COL.column_roles(df, {"a": {"is_bogus"}})
    vocab = spark.createDataFrame([("u", 2), ("v", 1)], "lemma string, df long")
    wide = WS.doc_term_wide(df.select("doc_id", F.lit("u").alias("lemma")), df, vocab, n=1)
    assert wide.columns == ["doc_id", "u"] and wide.first().u == 1
    assert COL.aux_column(df, ["a", "d"], "d").first().value == "2024-01-01"
    assert {(r.column_name, r.value) for r in COL.aux_columns(df, ["a", "d"]).collect()} == {("a", "x"), ("d", "2024-01-01")}
    with pytest.raises(KeyError):
        COL.aux_column(df, ["a"], "d")
