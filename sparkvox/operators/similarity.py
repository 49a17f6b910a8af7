"""Similarity join: pairs of vectors of a cosine of at least a threshold, by
random-hyperplane buckets with confirmation.

Equal vectors are one class, so copies never meet as rows. A class has a bit
per hyperplane, the bits are cut into bands, and classes that agree in all bits
of a band share a bucket. The number of bands follows from the threshold and the
recall asked for at it; pairs above the threshold are found more surely. Within a
bucket only the bits are compared: a pair goes on if too few bits differ to be
chance and no earlier band has brought it together, so each pair is looked at
once, and the cosine of the vectors then decides. Buckets of more than
BLOCK_ROWS classes are cut into blocks; every pair of blocks is a group of its
own, so no group grows with a bucket and no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkvox.functions import vectors as V
from sparkvox.session import scratch_path, ship_package

#: Classes of a bucket that are compared in one group.
BLOCK_ROWS = 512
RECALL = 0.95
MAX_BITS = 24
#: Standard deviations by which the differing bits of a pair may exceed their mean.
BIT_SLACK = 4.5
#: Salts over which the members of a class are reduced first.
SALTS = 64


def band_plan(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands: bands enough that a pair at the
    threshold shares one with the given chance, and the bits that make bands
    and chance meetings of ``n`` classes cost least together."""
    same = 1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi

    def bands(bits: int) -> int:
        return 1 if same >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-(same**bits))))

    bits = min(range(4, MAX_BITS + 1), key=lambda b: bands(b) * (1 + n / 2**b / 32))
    return bits, bands(bits)


def has_direction(vector: Column) -> Column:
    """Whether a vector has only finite components, not all zero; false for null."""
    finite = F.forall(V.as_double(vector), lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & (V.norm(vector) > 0), F.lit(False))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _signed(dims: int, bits: int, bands: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(dims, bands * bits))
        weights = (1 << np.arange(bits)).astype(np.int32)
        for batch in batches:
            step = max(1, (1 << 22) // (bands * bits))
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                sig = ((x @ planes > 0).reshape(len(x), bands, bits) @ weights).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], names=["class_no", "t", "c", "sig"])

    return run


def _met(bands: int, limit: int):
    """Pairs of a group: of different blocks, or of one block with itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, i, j = (batch.column(k).to_numpy() for k in range(3))
            groups = batch.column(3)
            ends, members = groups.offsets.to_numpy(), groups.values
            number, t, c, block = (members.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            sig = members.field(4).flatten().to_numpy().reshape(-1, bands)
            first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in range(batch.num_rows):
                own = np.arange(ends[g], ends[g + 1])
                left, right = (own[block[own] == x] for x in (i[g], j[g]))
                step = max(1, (1 << 20) // max(1, len(right) * bands))
                for s in range(0, len(left), step):
                    a = left[s:s + step]
                    wanted = (t[a][:, None] & c[right][None]) | (c[a][:, None] & t[right][None])
                    if i[g] == j[g]:
                        wanted &= number[a][:, None] < number[right][None]
                    p, q = np.nonzero(wanted)
                    apart = sig[a[p]] ^ sig[right[q]]
                    kept = ((apart == 0).argmax(axis=1) == band[g]) & (np.bitwise_count(apart).sum(axis=1) <= limit)
                    first.append(number[a[p[kept]]])
                    second.append(number[right[q[kept]]])
            a, b = np.concatenate(first), np.concatenate(second)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


@dataclass
class Linked:
    """``members(side, id, class_no)`` of every vector with a direction, and the
    linked ``pairs(a, b, score)`` of different classes, a below b."""

    members: DataFrame
    pairs: DataFrame


def linked_classes(rows: DataFrame, threshold: float, recall: float = RECALL, seed: int = 0) -> Linked:
    """Classes of equal vectors in ``rows(side, id, vector)`` and the pairs of
    classes whose cosine is ``threshold`` or more, of which one holds a row of
    side ``target`` and the other one of side ``corpus``. Vectors that are
    null, zero or not finite belong to no class."""
    spark = rows.sparkSession
    ship_package(spark)
    rows = rows.where(has_direction(F.col("vector"))).select("side", F.col("id").cast("long").alias("id"), V.as_double(F.col("vector")).alias("v"))
    classes = _written(
        rows.groupBy("v").agg(F.max(F.col("side") == "target").alias("t"), F.max(F.col("side") == "corpus").alias("c"))
        .select(F.monotonically_increasing_id().alias("class_no"), "t", "c", "v", V.l2_normalize(F.col("v")).alias("u")), "vector_classes")
    members = _written(rows.join(classes.select("v", "class_no"), "v").select("side", "id", "class_no"), "class_members")
    first = classes.first()
    if first is None:
        return Linked(members, spark.createDataFrame([], "a long, b long, score double"))
    bits, bands = band_plan(classes.count(), threshold, recall)
    angle = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    limit = math.ceil(bits * bands * angle + BIT_SLACK * math.sqrt(bits * bands * angle * (1 - angle)))
    signed = _written(classes.select("class_no", "t", "c", "u").mapInArrow(
        _signed(len(first["v"]), bits, bands, seed), "class_no long, t boolean, c boolean, sig array<int>"), "class_bits")
    dealt = signed.select("*", F.posexplode("sig").alias("band", "key"))
    sizes = dealt.groupBy("band", "key").agg(F.count("*").alias("n"), F.max("t").alias("any_t"), F.max("c").alias("any_c"))
    large = _written(sizes.where((F.col("n") > BLOCK_ROWS) & F.col("any_t") & F.col("any_c"))
                     .select("band", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "large_buckets")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = dealt.join(large, ["band", "key"], "left").select(
        "band", "key", F.struct("class_no", "t", "c", F.pmod(F.xxhash64("class_no"), blocks).cast("int").alias("block"), "sig").alias("m"), blocks.alias("blocks"))
    paired = placed.select("band", "key", "m", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "band", "key", F.least("m.block", "other").alias("i"), F.greatest("m.block", "other").alias("j"), "m")
    groups = paired.groupBy("band", "key", "i", "j").agg(F.collect_list("m").alias("ms")).where(F.size("ms") > 1)
    met = _written(groups.select("band", "i", "j", "ms").mapInArrow(_met(bands, limit), "a long, b long"), "met_classes")
    unit = classes.select("class_no", "u")
    pairs = (met.join(unit.toDF("a", "ua"), "a").join(unit.toDF("b", "ub"), "b")
             .select("a", "b", V.dot(F.col("ua"), F.col("ub")).alias("score")).where(F.col("score") >= threshold))
    return Linked(members, _written(pairs, "linked_classes"))


def _side(df: DataFrame, side: str, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.lit(side).alias("side"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct("a", "b", "score"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "score"))).alias("p")).select("p.*")


def _first_members(members: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids of each class, by salted parts first."""
    def least(df: DataFrame, *by: str | Column) -> DataFrame:
        w = Window.partitionBy("class_no", *by).orderBy("id")
        return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")

    salted = members.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return least(least(salted, "_salt")).select("class_no", "id")


def similar_docs_many(corpus: DataFrame, targets: DataFrame, k: int, threshold: float, id_col: str = "vec_id",
                      vec_col: str = "embedding", exclude_self: bool = True, recall: float = RECALL, seed: int = 0) -> DataFrame:
    """For every target the ``k`` most similar corpus rows among those of a
    cosine of ``threshold`` or more: ``(target_id, id, score, rank)``, ties by
    corpus id. For many targets; ``similar_docs`` compares all with all.

    A corpus row at the threshold is found with a chance of ``recall``, one
    above it more surely. The work grows with the rows, not with their product.
    Equal vectors are compared once; of each class only the ids that can be
    among the first ``k`` go on, so copies are not expanded into pairs."""
    linked = linked_classes(_side(targets, "target", id_col, vec_col).unionByName(_side(corpus, "corpus", id_col, vec_col)),
                            threshold, recall, seed)
    wanted = k + (1 if exclude_self else 0)
    asked = linked.members.where("side = 'target'")
    held = _first_members(linked.members.where("side = 'corpus'"), wanted)
    same = asked.select(F.col("class_no").alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(1.0).alias("score"))
    found = _both_ways(linked.pairs).unionByName(same).join(held.withColumnRenamed("class_no", "b"), "b")
    w = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= wanted).select(F.col("a").alias("class_no"), "id", "score")
    rows = asked.select(F.col("id").alias("target_id"), "class_no").join(best, "class_no")
    if exclude_self:
        rows = rows.where(F.col("target_id") != F.col("id"))
    w = Window.partitionBy("target_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target_id", "id", "score", "rank")


def similar_links(df: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding",
                  recall: float = RECALL, seed: int = 0) -> DataFrame:
    """One row per row of ``df``: ``id``, ``class_id`` (the smallest id of an
    equal vector) and ``n_links``, how many other rows have a cosine of
    ``threshold`` or more. A vector without a direction is alone."""
    rows = _side(df, "target", id_col, vec_col)
    linked = linked_classes(rows.unionByName(_side(df, "corpus", id_col, vec_col)), threshold, recall, seed)
    members = linked.members.where("side = 'target'").select("id", "class_no")
    sizes = _written(members.groupBy("class_no").agg(F.count("*").alias("n"), F.min("id").alias("class_id")), "class_sizes")
    others = (_both_ways(linked.pairs).join(sizes.select(F.col("class_no").alias("b"), "n"), "b")
              .groupBy(F.col("a").alias("class_no")).agg(F.sum("n").alias("others")))
    counts = _written(sizes.join(others, "class_no", "left").select(
        "class_no", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "class_links")
    found = members.join(counts, "class_no").select("id", "class_id", "n_links")
    return found.unionByName(rows.where(~has_direction(F.col("vector"))).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))
