"""Tokenisation into the flat word table and compound merging (group D).

The flat word table is the working contract of every later operator::

    words(doc_id, sent_id INT, word_id INT, text, lemma, is_stop BOOLEAN,
          pos, dep, ent_type [, lang, <kept doc columns>])

The built-in tokeniser is a rule tokeniser written only with Spark SQL
functions: each document row is split and exploded in place, and the POS
lexicon (a fixed table of about a hundred rows) is a broadcast hash join,
so tokenising plans no shuffle. It stands in for a language model;
a model tokeniser can be plugged in through ``tokenize_with`` (mapInPandas),
and every later operator only needs the table above.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.functions.text import is_capitalised
from sparkvox.operators.segment import Segmenter
from sparkvox.operators.tagger import Tagger
from sparkvox.session import ship_package

WORD_COLUMNS = ["doc_id", "sent_id", "word_id", "text", "lemma", "is_stop", "pos", "dep", "ent_type"]


def _suffix_pos(lemma: Column) -> Column:
    """POS of a word missing from the lexicon: the first matching suffix
    rule, else NUM for digits only, else NOUN."""
    rule = None
    for suffix, pos in L.SUFFIX_RULES:
        cond = lemma.endswith(suffix) & (F.length(lemma) >= len(suffix) + 2)
        rule = F.when(cond, F.lit(pos)) if rule is None else rule.when(cond, F.lit(pos))
    return rule.when(lemma.rlike(L.DIGITS_ONLY), F.lit(L.NUM_POS)).otherwise(F.lit(L.DEFAULT_POS))


def by_document(docs: DataFrame, id_col: str = "doc_id", n_partitions: int | None = None) -> DataFrame:
    """Hash-partition documents by id once, before tokenising.

    Shuffling the raw text is cheaper than shuffling the word table, and
    every later per-document or per-sentence aggregation (doc_term, padding,
    delimiter merge, compound chains) then finds its input already clustered
    by ``doc_id`` and plans no exchange. ``doc_id`` is unique, so the
    partitioning cannot be skewed.

    The partition count is explicit (``spark.sql.shuffle.partitions`` unless
    given): text is small in bytes but heavy in CPU, and AQE would otherwise
    coalesce it into a handful of partitions by size.
    """
    if n_partitions is None:
        n_partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n_partitions, F.col(id_col))


def tokenize_docs(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang_col: str | None = "lang",
    keep_cols: tuple[str, ...] = (),
    segmenter: Segmenter | None = None,
    tagger: Tagger | None = None,
) -> DataFrame:
    """Rule tokeniser: text → sentences → words with lemma/POS/entity/dep.

    sentences = pieces between runs of ``[.!?。！？\\n]``; words = runs of
    letters, marks and digits; ``sent_id``/``word_id`` are 0-based ordinals.
    A ``segmenter`` (see ``operators.segment``) cuts the runs of scripts written
    without spaces into words, in spaced and unspaced texts alike; without one
    such a run is one word. A ``tagger`` (see ``operators.tagger``) gives the
    parts of speech from whole sentences instead of word by word.
    ``keep_cols`` are document columns carried onto every word (e.g. a group
    label), which saves a join later.
    """
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    sents = docs.select(
        F.col(id_col).alias("doc_id"),
        lang.alias("lang"),
        *[F.col(c) for c in keep_cols],
        F.posexplode(F.split(F.col(text_col), L.SENTENCE_SPLIT, -1)).alias("sent_id", "sent"),
    )
    arr = sents.select(
        "doc_id", "lang", *keep_cols, "sent_id",
        # Maximal runs of letters/marks/digits: split on the complement and
        # drop the empty ends (same words as regexp_extract_all, cheaper).
        F.array_remove(F.split(F.col("sent"), f"[^{L.WORD_PATTERN[1:-2]}]+", -1), "").alias("ws"),
    )
    if segmenter is not None:
        ship_package(docs.sparkSession)
        arr = arr.withColumn("ws", segmenter.words(F.col("ws")))
    if tagger is not None:
        ship_package(docs.sparkSession)
        arr = arr.withColumn("tags", tagger.tags(F.col("lang"), F.transform("ws", F.lower)))
    # Every word next to its successor, by a second array that starts one word
    # later: no window, no shuffle, and the work per word is compiled.
    ws = F.col("ws")
    after = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    paired = F.arrays_zip(ws.alias("text"), after.alias("next"), *([F.col("tags").alias("tag")] if tagger is not None else []))
    words = arr.select("doc_id", "lang", *keep_cols, "sent_id", F.posexplode(paired).alias("word_id", "w"))
    words = words.select("doc_id", "lang", *keep_cols, "sent_id", "word_id", "w.*").withColumn("lemma", F.lower("text")).withColumn(
        "_key", F.concat(F.col("lang"), F.lit("|"), F.col("lemma"))
    )
    # The lexicon is a fixed table of about a hundred rows: a broadcast hash
    # join looks every word up once (and keeps the doc_id partitioning).
    lexicon = words.sparkSession.createDataFrame(L.lexicon_items(), "_key string, _lex_pos string")
    words = words.join(F.broadcast(lexicon), "_key", "left")
    return words.select(
        "doc_id", "sent_id", "word_id", "text", "lemma",
        F.coalesce(F.col("_key").isin(L.stop_keys()), F.lit(False)).alias("is_stop"),
        (F.col("tag") if tagger is not None else F.coalesce(F.col("_lex_pos"), _suffix_pos(F.col("lemma")))).alias("pos"),
        F.when(is_capitalised(F.col("text")) & is_capitalised(F.col("next")), F.lit(L.COMPOUND_DEP)).otherwise(F.lit(L.OTHER_DEP)).alias("dep"),
        F.when(is_capitalised(F.col("text")) & (F.col("word_id") > 0), F.lit(L.ENTITY_TYPE)).alias("ent_type"),
        "lang", *keep_cols,
    )


def tokenize_with(
    docs: DataFrame,
    tokenizer: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """Plug-in tokeniser: ``tokenizer`` maps a pandas batch of
    ``(doc_id, text)`` to word rows matching ``schema``. Runs once per Arrow
    batch on the executors (load the model lazily inside ``tokenizer``)."""

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield tokenizer(pdf)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def merge_compounds(words: DataFrame, mode: str = "merged") -> DataFrame:
    """Merge ``dep = 'compound'`` chains into one word.

    A chain is a run of compound words plus the first following
    non-compound word (or the sentence end). The merged word has the chain's
    texts and lemmas joined by a space, ``is_stop = False`` and the POS /
    entity of its last word; vectors (if any) are averaged.

    ``mode='merged'``: one word per chain. ``mode='overlapping'``: every
    word of a chain starts its own span up to the chain end (A B C → ABC,
    BC, C), which is what a per-token loop without skipping produces.

    Plan: one window per sentence finds chain starts (a running sum). Most
    words are a chain by themselves and go straight to the result; the words of
    longer chains are grouped per chain, which reuses the window's partitioning
    on (doc_id, sent_id).
    """
    if mode not in ("merged", "overlapping"):
        raise ValueError("mode must be 'merged' or 'overlapping'")
    w = Window.partitionBy("doc_id", "sent_id").orderBy("word_id")
    prev_compound = F.coalesce(F.lag(F.col("dep") == L.COMPOUND_DEP).over(w), F.lit(False))
    has_vec = "vector" in words.columns
    seg = words.withColumn("_prev_c", prev_compound).withColumn(
        "chain", F.sum(F.when(F.col("_prev_c"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    fields = [F.col("word_id"), F.col("text"), F.col("lemma"), F.col("is_stop"), F.col("pos"),
              F.col("ent_type"), F.col("dep")]
    if has_vec:
        fields.append(F.col("vector"))
    alone = ~F.col("_prev_c") & ~F.coalesce(F.col("dep") == L.COMPOUND_DEP, F.lit(False))
    single = seg.where(alone).select(
        "doc_id", "sent_id", "word_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lemma", F.lit("")).alias("lemma"),
        "is_stop", "pos", "ent_type", F.lit(1).alias("n_tokens"),
        *([F.transform("vector", lambda x: F.lit(0.0) + x).alias("vector")] if has_vec else []),
    )
    chains = seg.where(~alone).groupBy("doc_id", "sent_id", "chain").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("ws")
    )
    n = F.size("ws")

    def span(start: Column) -> Column:
        part = F.slice(F.col("ws"), start + 1, n - start)
        last = F.element_at(F.col("ws"), -1)
        first = F.element_at(part, 1)
        cols = [
            F.element_at(part, 1)["word_id"].alias("word_id"),
            F.array_join(F.transform(part, lambda x: x["text"]), " ").alias("text"),
            F.array_join(F.transform(part, lambda x: x["lemma"]), " ").alias("lemma"),
            F.when(first["dep"] == L.COMPOUND_DEP, F.lit(False)).otherwise(first["is_stop"]).alias("is_stop"),
            last["pos"].alias("pos"),
            last["ent_type"].alias("ent_type"),
            F.size(part).alias("n_tokens"),
        ]
        if has_vec:
            dim = F.size(F.element_at(part, 1)["vector"])
            summed = F.aggregate(
                F.transform(part, lambda x: x["vector"]),
                F.array_repeat(F.lit(0.0), dim),
                lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b),
            )
            cols.append(F.transform(summed, lambda x: x / F.size(part)).alias("vector"))
        return F.struct(*cols)

    if mode == "merged":
        out = chains.select("doc_id", "sent_id", span(F.lit(0)).alias("m"))
    else:
        out = chains.select(
            "doc_id", "sent_id",
            F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda s: span(s))).alias("m"),
        )
    return single.unionByName(out.select("doc_id", "sent_id", "m.*"))
