"""Exact deduplication by content-defined chunk recipes.

A text without its white space is cut where its own content says so, so equal
texts have equal chunks. Chunks are deduplicated to identifiers: a 64-bit
address, verified against a SHA-256 witness; chunks that share an address but
not the witness get different identifiers. A document is then its recipe, the
ordered list of identifiers, and equal documents are those with equal recipes.
Long texts are read once and never shuffled: what moves are 8-byte addresses,
witnesses and recipes, a few bytes per hundred characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvox.llm.common import SPACES, filled, unused, written

#: Code points of a chunk: no cut before MIN_CHUNK, one at MAX_CHUNK at the latest.
MIN_CHUNK, MAX_CHUNK = 256, 4096


def cut_class(residue: int, modulus: int = 8) -> str:
    """Regex class of the code points up to U+02FF that a multiplicative hash
    sends to ``residue``: content decides where to cut, in any language of
    these blocks. Other scripts are cut at MAX_CHUNK."""
    chosen = [c for c in range(0x21, 0x300) if (c * 2654435761 >> 13) % modulus == residue]
    return "[" + "".join(f"\\x{{{c:x}}}" for c in chosen) + "]"


#: A chunk ends behind a character of one class that follows one of another: about one place in 64.
CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={cut_class(1)}{cut_class(2)})|.{{1,{MAX_CHUNK}}}"


def without_spaces(text: Column) -> Column:
    return F.translate(filled(text), SPACES, "")


def recipes(docs: DataFrame, id_col: str, text_col: str, address: Callable[[Column], Column]) -> DataFrame:
    """``(rid, id, length, sha, chunks)``: one row per row of ``docs``; chunks
    in order, each with address a and witness w."""
    base = docs.select(F.col(id_col).alias("id"), F.length(filled(F.col(text_col))).alias("length"),
                       without_spaces(F.col(text_col)).alias("norm"))
    return base.select(
        F.monotonically_increasing_id().alias("rid"), "id", "length", F.sha2("norm", 256).alias("sha"),
        F.transform(F.regexp_extract_all("norm", F.lit(CHUNK), 0),
                    lambda c: F.struct(address(c).alias("a"), F.unhex(F.sha2(c, 256)).alias("w"))).alias("chunks"))


def identified(made: DataFrame) -> DataFrame:
    """``(rid, recipe)`` for rows with chunks: the ordered identifiers, each an
    address and the number of its witness among those of the address."""
    pieces = made.select("rid", F.posexplode("chunks").alias("pos", "c")).select("rid", "pos", "c.a", "c.w")
    # One row per distinct chunk; an address has one witness unless it collides.
    known = written(pieces.select("a", "w").distinct().withColumn(
        "r", F.row_number().over(Window.partitionBy("a").orderBy("w"))), "chunk_ids")
    return (pieces.join(known, ["a", "w"])
            .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "r"))).alias("ids"))
            .select("rid", F.transform("ids", lambda x: F.struct(x["a"].alias("a"), x["r"].alias("r"))).alias("recipe")))


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    address: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``, ``n_points`` (code points of the text).

    Texts are equal if they are after deleting ``[\\x20\\x09-\\x0D]``; a null
    text is an empty one. Of equal texts the row with the most code points,
    then the smallest id (null last) stays; of repeated rows exactly one.
    Empty tables give no rows; other columns of ``docs`` play no part.
    ``address`` may be any hash: identifiers are right for weak ones too."""
    made = written(recipes(docs, id_col, text_col, address), "recipes")
    ids = identified(made)
    # Rows without chunks (empty texts) have the empty recipe.
    cooked = written(
        made.where(F.size("chunks") == 0).select(
            "rid", "id", "length", "sha", F.array().cast("array<struct<a:bigint,r:int>>").alias("recipe"))
        .unionByName(made.select("rid", "id", "length", "sha").join(ids, "rid")), "cooked")
    order = F.struct((-F.col("length")).alias("l"), F.col("id").isNull().alias("no_id"), "id", "rid")
    groups = cooked.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    groups = written(groups, "recipe_groups")
    out = cooked.join(groups, "recipe")
    return out.select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"),
        F.col("length").cast("long").alias("n_points"))


def without_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    i, sha, n = unused(docs, "_id", "_sha", "_n")
    stay = (exact_duplicates(docs, id_col=id_col, text_col=text_col).where("kept")
            .select(F.col(id_col).alias(i), F.col("text_sha256").alias(sha), F.col("n_points").alias(n)))
    own = docs.withColumn(f"{sha}k", F.sha2(without_spaces(F.col(text_col)), 256))
    match = own[id_col].eqNullSafe(stay[i]) & (own[f"{sha}k"] == stay[sha]) \
        & (F.length(filled(own[text_col])) == stay[n])
    # Repeated rows (same id, same text but for white space) match together; one stays.
    return (own.join(stay, match).dropDuplicates([i, sha]).select(*docs.columns))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, points AS n_points FROM n JOIN g USING (text_sha256)
"""
