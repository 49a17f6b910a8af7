"""Sentence-level word co-occurrence and its network (group E).

Plan, written so that the pair work stays bounded and the words are read once:

1. semi-join the words with the vocabulary (broadcast by AQE if it is small);
2. one set of words per sentence: duplicates within a sentence count once;
3. every unordered pair of a set by exploding blocks of the sorted set, block
   by block, so a sentence of many words never makes an array of its pairs;
4. partial + final count per pair (map-side combine before the shuffle);
5. mirror to both orders with an ``explode`` (no second join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L

# Words of a block of a sentence's set.
BLOCK = 256


def sentence_pairs(words: DataFrame, vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """Undirected pair counts (lemma1 < lemma2, n = sentences with both).

    The sorted set of a sentence is cut into blocks of ``block`` words. Each
    pair of blocks is one row, which is exploded into its pairs: a row is at
    most two blocks wide however long the sentence is."""
    sets = (
        words.join(vocab.select("lemma"), "lemma", "left_semi")
        .groupBy("doc_id", "sent_id")
        .agg(F.sort_array(F.collect_set("lemma")).alias("s"))
        .filter(F.size("s") > 1)
    )
    starts = F.sequence(F.lit(0), F.floor((F.size("s") - 1) / block).cast("int"))
    blocks = sets.select(F.transform(starts, lambda b: F.slice("s", b * block + 1, block)).alias("blocks"))
    left = blocks.select("blocks", F.posexplode("blocks").alias("p", "a"))
    both = left.select(
        "p", "a", F.posexplode(F.slice("blocks", F.col("p") + 1, F.size("blocks"))).alias("q", "b")
    )
    pairs = (
        both.select("q", "b", F.explode("a").alias("lemma1"))
        .select("q", "lemma1", F.explode("b").alias("lemma2"))
        # A block paired with itself gives each pair twice; blocks are in order otherwise.
        .filter((F.col("q") > 0) | (F.col("lemma1") < F.col("lemma2")))
    )
    return pairs.groupBy("lemma1", "lemma2").agg(F.count(F.lit(1)).alias("n"))


def co_occurrence(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Symmetric co-occurrence (both orders, zero diagonal left out)."""
    return mirror_pairs(sentence_pairs(words, vocab))


def mirror_pairs(und: DataFrame) -> DataFrame:
    """Undirected pair counts → both orders, by one explode (no join)."""
    both = F.array(
        F.struct(F.col("lemma1").alias("a"), F.col("lemma2").alias("b"), "n"),
        F.struct(F.col("lemma2").alias("a"), F.col("lemma1").alias("b"), "n"),
    )
    return und.select(F.explode(both).alias("p")).select(
        F.col("p.a").alias("lemma1"), F.col("p.b").alias("lemma2"), F.col("p.n").alias("n")
    )


def co_occurrence_edges(
    pairs: DataFrame,
    docs: DataFrame,
    n_edge: int = L.N_EDGE,
    min_co_occurrence: float | int = L.MIN_CO_OCCURRENCE,
) -> DataFrame:
    """Network edges from undirected pair counts: a pair is kept if it is
    among the ``n_edge`` heaviest (ties by words) and its count reaches the
    minimum (int = absolute, float = share of all documents). Weight is
    count / largest count; display width is 12 x weight."""
    if isinstance(min_co_occurrence, bool):
        raise TypeError("min_co_occurrence must be int or float")
    if isinstance(min_co_occurrence, int):
        minimum = F.lit(min_co_occurrence)
    else:
        minimum = F.lit(float(min_co_occurrence)) * docs.select(F.count(F.lit(1))).scalar()
    top = pairs.orderBy(F.desc("n"), "lemma1", "lemma2").limit(n_edge)
    max_n = F.max("n").over(Window.partitionBy())  # over <= n_edge rows
    out = top.withColumn("max_n", max_n).filter(F.col("n") >= minimum)
    weight = F.col("n") / F.col("max_n")
    return out.select(
        "lemma1", "lemma2", "n", weight.alias("weight"), (weight * L.EDGE_WIDTH_SCALE).alias("width")
    )


def co_occurrence_nodes(edges: DataFrame, vocab: DataFrame, pos_vote: DataFrame) -> DataFrame:
    """Words on a kept edge. size = df / max df over the whole vocabulary,
    display size 30 x size, colour by the word's majority POS. When no edge
    is kept, a single placeholder node carries the message."""
    max_df = vocab.select(F.max("df")).scalar()
    on_edge = edges.select(F.explode(F.array("lemma1", "lemma2")).alias("lemma")).distinct()
    color = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in L.POS_COLORS.items() for x in kv]), F.col("pos")),
        F.lit(L.OTHER_POS_COLOR),
    )
    shown = vocab.select("lemma", "df").join(on_edge, "lemma", "left_semi")
    nodes = (
        shown.join(pos_vote.join(on_edge, "lemma", "left_semi"), "lemma", "left")
        .select(
            "lemma",
            (F.col("df") / max_df).alias("size"),
            (F.col("df") / max_df * L.NODE_SIZE_SCALE).alias("display_size"),
            color.alias("color"),
        )
    )
    placeholder = (
        edges.sparkSession.range(1)
        .select(
            F.lit(L.EMPTY_NETWORK_LABEL).alias("lemma"),
            F.lit(None).cast("double").alias("size"),
            F.lit(None).cast("double").alias("display_size"),
            F.lit(L.EMPTY_NETWORK_COLOR).alias("color"),
        )
        .filter(~edges.exists())
    )
    return nodes.unionByName(placeholder)
