"""Line deduplication by distinct-site spread.

A line that many sites carry is boilerplate (licence lines, menus, notices).
How many sites carry a line is first estimated with one HyperLogLog sketch per
line hash: sketches are built next to the data, merged by the aggregation and
bounded in size however common the line is. Lines far above the threshold are
boilerplate, lines far below are not; those near it get an exact distinct
count. Boilerplate then goes everywhere except its first occurrence, so a line
shared by near copies is not lost from the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkvox.llm.common import filled, unused, written

#: 2**12 registers: standard error 1.6 %, exact in practice for small counts.
LOG_REGISTERS = 12
#: Estimates within this share of the threshold (one site at least) are counted exactly: 6 standard errors.
NEAR = 0.1
#: Values of the hash that texts are told apart by before any of them moves.
SLOTS = 1 << 20


def line_hash(line: Column) -> Column:
    """128 bits of a line, so that two lines of 100 TB don't meet by chance."""
    return F.unhex(F.md5(line.cast("binary")))


def eligible(line: Column, min_chars: int) -> Column:
    """Lines that can be boilerplate: long enough, with something on them."""
    return (F.length(line) >= min_chars) & (F.trim(line) != "")


def line_sites(docs: DataFrame, id_col: str, site_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(doc, text_hash, pos, site, h)`` of the eligible lines."""
    base = docs.select(F.col(id_col).alias("doc"), F.col(site_col).cast("string").alias("site"),
                       filled(F.col(text_col)).alias("text"))
    lines = base.select("doc", "site", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_hash"),
                        F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(eligible(F.col("line"), min_chars)).select(
        "doc", "text_hash", "pos", "site", line_hash(F.col("line")).alias("h"))


def line_spread(lines: DataFrame) -> DataFrame:
    """``(h, spread)``: estimated distinct sites of each line hash."""
    return lines.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("spread"))


def boilerplate_places(lines: DataFrame, min_sites: int) -> DataFrame:
    """``(doc, text_hash, pos)`` of every boilerplate line but its first
    occurrence (the smallest doc, null last, then text hash, then place)."""
    margin = max(1, round(NEAR * min_sites))
    spread = line_spread(lines).where(F.col("spread") >= min_sites - margin)
    wide = written(spread.select("h", (F.col("spread") > min_sites + margin).alias("sure")), "line_spread")
    # The few candidate lines with all their places; a hot line is one row on
    # the right, so AQE can split it on the left.
    places = written(lines.join(wide, "h"), "line_places")
    exact = (places.where(~F.col("sure")).select("h", "site").where(F.col("site").isNotNull()).distinct()
             .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h"))
    chosen = written(exact.union(wide.where("sure").select("h")), "line_boilerplate")
    place = F.struct(F.col("doc").isNull().alias("no_doc"), "doc", "text_hash", "pos")
    first = places.groupBy("h").agg(F.min(place).alias("first"))
    keep = written(chosen.join(first, "h"), "line_first")
    found = places.select("h", "doc", "text_hash", "pos").join(keep, "h")
    return found.where(~place.eqNullSafe(F.col("first"))).select("doc", "text_hash", "pos")


def dedup_lines(
    docs: DataFrame,
    *,
    min_sites: int = 5,
    min_chars: int = 20,
    id_col: str = "doc_id",
    site_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus ``n_lines``
    (lines before) and ``n_removed``.

    A line (between ``\\n``) of at least ``min_chars`` code points that
    ``min_sites`` distinct sites carry is removed at all places but its first.
    Null sites count as no site. Null texts stay null (one empty line); rows
    with the same id and text are treated alike; an empty table stays empty. If
    ``docs`` has columns of the added names, the added ones get underscores."""
    n_lines, n_removed, doc, h, gone, parts, slot, hit = unused(
        docs, "n_lines", "n_removed", "_doc", "_text_hash", "_gone", "_parts", "_slot", "_hit")
    places = boilerplate_places(line_sites(docs, id_col, site_col, text_col, min_chars), min_sites)
    # Of one document's text: bounded by that text.
    marks = written(places.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("pos")), "line_marks")
    marks = marks.toDF(doc, h, gone)
    text = F.col(text_col)
    keyed = docs.withColumn(f"{h}k", F.unhex(F.md5(filled(text).cast("binary"))))

    def slot_of(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias(slot)

    # SLOTS rows at most, so it may be broadcast: texts without a mark stay
    # where they are, only the others are shuffled to their marks.
    slots = F.broadcast(marks.select(slot_of(h)).distinct().withColumn(hit, F.lit(True)))
    looked = keyed.withColumn(slot, slot_of(f"{h}k")).join(slots, slot, "left")
    none = looked.where(F.col(hit).isNull()).withColumn(gone, F.lit(None).cast("array<int>"))
    some = looked.where(F.col(hit))
    some = some.join(marks, some[id_col].eqNullSafe(marks[doc]) & (some[f"{h}k"] == marks[h]), "left")
    kept = [*docs.columns, gone]
    joined = some.select(*kept).unionByName(none.select(*kept))
    split = joined.withColumn(parts, F.split(filled(text), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    rebuilt = F.when(F.col(gone).isNull(), text).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col(parts), i)), "\n"))
    others = [F.col(c) if c != text_col else rebuilt.alias(text_col) for c in docs.columns]
    return split.select(
        *others, F.size(parts).alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).alias(n_removed))


def oracle_sql(min_sites: int = 5, min_chars: int = 20) -> str:
    """The same in DuckDB over ``documents``, with exact counts throughout."""
    return f"""
WITH split AS (SELECT doc_id, source, text, md5(coalesce(text, '')) AS th, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, th, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM split),
wide AS (SELECT line FROM lines WHERE length(line) >= {min_chars} AND trim(line, ' ') <> '' GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
ranked AS (SELECT doc_id, th, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, th, pos) AS r FROM lines JOIN wide USING (line)),
gone AS (SELECT doc_id, th, list(pos) AS gone FROM ranked WHERE r > 1 GROUP BY doc_id, th)
SELECT s.doc_id, CASE WHEN g.gone IS NULL THEN s.text ELSE array_to_string([parts[i + 1] FOR i IN range(0, len(parts)) IF NOT list_contains(g.gone, i)], chr(10)) END AS text,
  len(parts)::INTEGER AS n_lines, coalesce(len(g.gone), 0)::INTEGER AS n_removed
FROM split s LEFT JOIN gone g ON s.doc_id IS NOT DISTINCT FROM g.doc_id AND s.th = g.th
"""
