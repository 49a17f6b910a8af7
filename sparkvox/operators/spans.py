"""Alignment of two cuts of a text: words and a model's sub-tokens, each with
its place in characters.

Spans are dealt to the blocks of text they touch, so words and sub-tokens meet
by an equi-join on (document, block): the work is linear in the text, and a long
document spreads over its blocks. A pair that touches in several blocks counts
in the one where the later of the two begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a block.
BLOCK = 64


def word_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, word_id, text, start, stop)``: the words between spaces and
    their places; ``stop`` is behind the last character."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, " ")).alias("word_id", "text"))
    before = Window.partitionBy("doc_id").orderBy("word_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    placed = parts.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))
    return placed.where(F.col("text") != "")


def _dealt(spans: DataFrame, block: int) -> DataFrame:
    first, last = (F.floor(c / block) for c in (F.col("start"), F.col("stop") - 1))
    return spans.where(F.col("start") < F.col("stop")).withColumn("_block", F.explode(F.sequence(first, last)))


def overlapping(words: DataFrame, subtokens: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of a word and a sub-token of the same document that share a
    character: the columns of both, the sub-token's without ``doc_id`` and
    places. Spans without a character overlap nothing."""
    w = _dealt(words, block)
    s = _dealt(subtokens.withColumnRenamed("doc_id", "_doc"), block).select(
        "_doc", F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("_block").alias("_b"),
        *[c for c in subtokens.columns if c not in ("doc_id", "start", "stop")])
    both: Column = (F.col("start") < F.col("_stop")) & (F.col("_start") < F.col("stop"))
    once = F.col("_block") == F.floor(F.greatest("start", "_start") / block)
    joined = w.join(s, (F.col("doc_id") == F.col("_doc")) & (F.col("_block") == F.col("_b")) & both & once)
    return joined.drop("_doc", "_start", "_stop", "_b", "_block")


def subtoken_pool_aligned(words: DataFrame, subtokens: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """``words(doc_id, word_id, start, stop)`` with ``vector``, the mean of the
    vectors of the sub-tokens ``(doc_id, start, stop, vector)`` that overlap the
    word; the zero vector where none does.

    Words and sub-tokens of a block of text are gathered by one aggregate, and
    the sums of a word's blocks by a window. Inputs that are dealt to the same
    partitions by ``doc_id`` stay where they are; none of their rows moves."""
    whole = F.col("start") < F.col("stop")
    first, last = (F.floor(c / block) for c in (F.col("start"), F.col("stop") - 1))
    w = words.select("doc_id", F.struct(*words.columns).alias("_w"), F.explode_outer(F.when(whole, F.sequence(first, last))).alias("_block"))
    s = subtokens.where(whole & F.col("doc_id").isNotNull()).select(
        "doc_id", F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"),
                           F.transform("vector", lambda x: x.cast("double")).alias("vector")).alias("_s"),
        F.explode(F.sequence(first, last)).alias("_block"))
    both = w.select("doc_id", "_block", "_w", F.lit(None).cast(s.schema["_s"].dataType).alias("_s")).unionAll(
        s.select("doc_id", "_block", F.lit(None).cast(w.schema["_w"].dataType).alias("_w"), "_s"))
    met = (both.groupBy("doc_id", "_block").agg(F.collect_list("_w").alias("_ws"), F.collect_list("_s").alias("_ss"))
           .select("doc_id", "_block", "_ss", F.explode("_ws").alias("_w")))

    def counts(t: Column) -> Column:
        """Whether a sub-token of the block overlaps the word and counts here: the later of the two begins here."""
        start, stop = F.col("_w.start"), F.col("_w.stop")
        once = F.floor(F.greatest(start, t["start"]) / block) == F.col("_block")
        return (start < t["stop"]) & (t["start"] < stop) & once & t["vector"].isNotNull()

    def added(vectors: Column) -> Column:
        zero = F.array_repeat(F.lit(0.0), F.size(vectors[0]))
        return F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))

    keyed = F.col("doc_id").isNotNull() & F.col("_w.word_id").isNotNull()
    met = met.select("doc_id", "_w", "_block", F.when(keyed, F.transform(F.filter("_ss", counts), lambda t: t["vector"])).alias("_hits"))
    some = F.size("_hits") > 0
    met = met.select("doc_id", "_w", "_block", F.when(some, F.size("_hits")).alias("_n"), F.when(some, added(F.col("_hits"))).alias("_sum"))
    word = Window.partitionBy("doc_id", "_word")
    met = met.withColumn("_word", F.col("_w.word_id")).select("_w", "_block", F.sum("_n").over(word).alias("_n"), F.collect_list("_sum").over(word).alias("_sums"))
    # A word's row of its first block stands for it.
    met = met.where(F.col("_block").isNull() | (F.col("_block") == F.floor(F.col("_w.start") / block)))
    counts_ = F.array_repeat(F.col("_n"), F.size(F.col("_sums")[0]))
    mean = F.when(F.size("_sums") > 0, F.zip_with(added(F.col("_sums")), counts_, lambda x, n: x / n))
    return met.select("_w.*", F.coalesce(mean, F.array_repeat(F.lit(0.0), dim)).alias("vector"))
