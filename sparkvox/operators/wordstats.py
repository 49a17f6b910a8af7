"""Word statistics over the flat word table (group E).

All operators are lazy DataFrame plans. Aggregations are hash aggregates
with map-side partial aggregation, so a very frequent word (a hot key) only
ships one partial row per task. Nothing is broadcast by a hint: AQE broadcasts
a vocabulary whose measured size allows it, and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.functions.text import join_with_delimiter, split_by_delimiter


# ---------------------------------------------------------------------------
# POS vote and content-word filter
# ---------------------------------------------------------------------------

def word_pos_majority(words: DataFrame) -> DataFrame:
    """lemma → most frequent POS over all (unfiltered) words; ties → the
    alphabetically first POS. Counted per (lemma, POS) first, so the vote
    sees a handful of rows per lemma however common it is."""
    counts = words.groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("lemma").agg(F.min_by("pos", F.struct(-F.col("n"), "pos")).alias("pos"))


def relevant_predicate(lemma: Column, pos: Column, is_stop: Column, ent_type: Column) -> Column:
    """Content-word predicate, in order: dropped lemmas; relevant POS and not
    a stop word (AUX only for the kept lemma); otherwise a non-empty entity."""
    pos_ok = pos.isin(L.RELEVANT_POS) & ~F.coalesce(is_stop, F.lit(False))
    return (~F.coalesce(lemma.isin(L.ALWAYS_DROPPED_LEMMAS), F.lit(False))) & F.coalesce(
        F.when(pos_ok, (pos != "AUX") | (lemma == L.KEPT_AUX_LEMMA))
        .otherwise(F.coalesce(ent_type, F.lit("")) != ""),
        F.lit(False),
    )


def filter_relevant(words: DataFrame) -> DataFrame:
    return words.filter(relevant_predicate(F.col("lemma"), F.col("pos"), F.col("is_stop"), F.col("ent_type")))


def pad_empty_sentences(words: DataFrame) -> DataFrame:
    """Filter to content words; a sentence left empty keeps one placeholder
    word (text/lemma "", NOUN, stop word, word_id -1).

    The content words pass a filter; one hash aggregate per sentence finds
    the empty ones and adds a row for each. Input clustered by ``doc_id``
    (the tokeniser's output) needs no exchange for that, and nothing is
    sorted or stored a second time.
    """
    rel = relevant_predicate(F.col("lemma"), F.col("pos"), F.col("is_stop"), F.col("ent_type"))
    base = ["doc_id", "sent_id", "word_id", "text", "lemma", "is_stop", "pos", "dep", "ent_type"]
    # Document-level columns carried by the tokeniser (e.g. lang, a label).
    carry = [c for c in words.columns if c not in base and c != "vector"]
    kept = words.filter(rel).select(*base, *carry)
    empty = (
        words.groupBy("doc_id", "sent_id", *carry).agg(F.max(rel.cast("int")).alias("_any")).filter(F.col("_any") == 0)
    )
    fields = {f.name: f.dataType for f in words.schema.fields}
    filler = {"word_id": -1, "text": "", "lemma": "", "is_stop": True, "pos": "NOUN", "dep": None, "ent_type": None}
    pads = empty.select(
        "doc_id", "sent_id", *[F.lit(v).cast(fields[c]).alias(c) for c, v in filler.items()], *carry
    )
    return kept.unionByName(pads)


# ---------------------------------------------------------------------------
# Delimited documents
# ---------------------------------------------------------------------------

def merge_by_delimiter(words: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: every lemma in (sentence, word) order joined by 0x1D,
    plus a trailing 0x1D. A document without words gives a single 0x1D.
    One group holds one document, so it is bounded by an input row."""
    per_doc = words.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("sent_id", "word_id", "lemma"))).alias("ws")
    )
    return (
        docs.select(F.col(id_col).alias("doc_id"))
        .join(per_doc, "doc_id", "left")
        .select(
            "doc_id",
            join_with_delimiter(F.coalesce(F.transform("ws", lambda x: x["lemma"]), F.array().cast("array<string>")))
            .alias("merged"),
        )
    )


def split_merged(merged: DataFrame) -> DataFrame:
    """Inverse of ``merge_by_delimiter``: one row per non-empty token."""
    return merged.select(
        "doc_id", F.posexplode(split_by_delimiter(F.col("merged"))).alias("token_id", "lemma")
    )


# ---------------------------------------------------------------------------
# Document frequency and vocabulary
# ---------------------------------------------------------------------------

def doc_term(words: DataFrame) -> DataFrame:
    """Binary document × word incidence as a long table."""
    return words.filter(F.col("lemma") != "").select("doc_id", "lemma").distinct()


def _threshold(value: float | int, n_docs: Column) -> Column:
    """int = absolute document count, float = share of all documents."""
    if isinstance(value, bool):
        raise TypeError("threshold must be int or float")
    if isinstance(value, int):
        return F.lit(value)
    return F.lit(float(value)) * n_docs


def doc_frequency(
    words: DataFrame,
    docs: DataFrame,
    min_df: float | int = L.MIN_DOCUMENT_FREQUENCY,
    max_df: float | int = L.MAX_DOCUMENT_FREQUENCY,
    max_vocab_size: int | None = None,
) -> DataFrame:
    """Documents per word, kept if min_df <= df <= max_df; with
    ``max_vocab_size`` only that many of the most frequent (ties
    alphabetical). N counts every row
    of ``docs``, including documents without words. An explicit 0 is
    honoured (no fallback to the default)."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    dfreq = doc_term(words).groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    kept = dfreq.filter((F.col("df") >= _threshold(min_df, n_docs)) & (F.col("df") <= _threshold(max_df, n_docs)))
    if max_vocab_size is not None:
        kept = kept.orderBy(F.desc("df"), F.asc("lemma")).limit(max_vocab_size)
    return kept


def frequent_words(doc_freq: DataFrame, n: int) -> DataFrame:
    """Top-``n`` words by document frequency (ties alphabetical), with their
    1-based rank. The window runs over at most ``n`` rows."""
    top = doc_freq.orderBy(F.desc("df"), F.asc("lemma")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), F.asc("lemma"))))


def doc_term_wide(words: DataFrame, docs: DataFrame, vocab: DataFrame, n: int = L.N_WIDE_WORDS) -> DataFrame:
    """The ``n`` most frequent words of ``vocab(lemma, df)`` as 0/1 columns
    (alphabetical), one row per document. The words become column names, so
    these ``n`` are read on the driver."""
    names = sorted(r["lemma"] for r in frequent_words(vocab, n).select("lemma").collect())
    present = doc_term(words).join(vocab.select("lemma"), "lemma", "left_semi")
    wide = present.groupBy("doc_id").pivot("lemma", names).agg(F.lit(1))
    out = docs.select("doc_id").join(wide, "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("int").alias(c) for c in names])


def word_frequencies_for(doc_freq: DataFrame, wanted: DataFrame, order: str = "desc") -> DataFrame:
    """Frequencies for the words in ``wanted(pos, lemma)``; a word that is
    not counted gets 0. ``order='input'`` keeps ``pos``; ``'desc'`` ranks by
    frequency (ties alphabetical)."""
    freq = wanted.join(doc_freq.select("lemma", "df"), "lemma", "left").select(
        "pos", "lemma", F.coalesce("df", F.lit(0)).cast("long").alias("freq")
    )
    if order == "input":
        return freq.select(F.col("pos").alias("position"), "lemma", "freq")
    if order == "desc":
        w = Window.orderBy(F.desc("freq"), F.asc("lemma"))
        return freq.select(F.row_number().over(w).alias("position"), "lemma", "freq")
    raise ValueError("order must be 'input' or 'desc'")


# ---------------------------------------------------------------------------
# TF-IDF per label
# ---------------------------------------------------------------------------

def tfidf_by_label(
    words: DataFrame,
    vocab: DataFrame,
    labels: DataFrame,
    label_col: str = "label",
) -> DataFrame:
    """All documents of a label form one text; raw term counts over the
    fixed ``vocab``; idf = ln((1+L)/(1+lf)) + 1 (L labels, lf labels holding
    the word); every label row L2-normalised.

    ``labels`` has a row per document with its ``label_col``: L counts every
    label there, also those whose documents hold no word of the vocabulary.
    The label of a word comes from ``words[label_col]`` when the tokeniser
    carried it, else from ``labels(doc_id, label_col)`` after a per-document
    pre-aggregation (so the join sees (doc, word) rows, not every token).
    Documents with a NULL label are left out.
    """
    in_vocab = words.join(vocab.select("lemma"), "lemma", "left_semi")
    if label_col in words.columns:
        counts = in_vocab.groupBy(label_col, "lemma").agg(F.count(F.lit(1)).alias("tf"))
    else:
        per_doc = in_vocab.groupBy("doc_id", "lemma").agg(F.count(F.lit(1)).alias("n"))
        counts = (
            per_doc.join(labels.select("doc_id", label_col), "doc_id")
            .groupBy(label_col, "lemma")
            .agg(F.sum("n").alias("tf"))
        )
    counts = counts.filter(F.col(label_col).isNotNull())
    n_labels = labels.select(F.size(F.collect_set(F.col(label_col)))).scalar()  # as many as there are result groups
    # Rows per word are bounded by the labels, rows per label by the vocabulary.
    lf = F.count(F.lit(1)).over(Window.partitionBy("lemma"))
    weighted = counts.withColumn(
        "w", F.col("tf") * (F.log((F.lit(1) + n_labels) / (F.lit(1) + lf)) + F.lit(1.0))
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(label_col)))
    return weighted.select(
        F.col(label_col).alias("label"), "lemma", "tf", F.try_divide(F.col("w"), norm).alias("weight")
    )


def label_vectors(tfidf: DataFrame) -> DataFrame:
    """Per label, the non-zero (word, weight) list sorted by word.
    A label's list is bounded by the vocabulary size."""
    return (
        tfidf.filter(F.col("weight") > 0)
        .groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("lemma", "weight"))).alias("vector"))
    )


def top_words_by_label(tfidf: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest words of every label (ties alphabetical)."""
    w = Window.partitionBy("label").orderBy(F.desc("weight"), F.asc("lemma"))
    return tfidf.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def compare_frequencies(words: DataFrame, selected_docs: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Document frequency overall next to the frequency among selected
    documents (``selected_docs(doc_id)``), ranked by the selected one
    descending (ties: overall descending, then word)."""
    dt = doc_term(words)
    if vocab is not None:
        dt = dt.join(vocab.select("lemma"), "lemma", "left_semi")
    sel = selected_docs.select("doc_id").distinct().withColumn("_sel", F.lit(True))
    flagged = dt.join(sel, "doc_id", "left")
    agg = flagged.groupBy("lemma").agg(
        F.count(F.lit(1)).alias("overall"), F.count_if(F.coalesce("_sel", F.lit(False))).alias("selected")
    )
    return agg
