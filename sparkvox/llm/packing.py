"""Best-fit packing planned on the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. The plan is made
on counts per length, not on pieces: longest first, all pieces of a length go
at once to the sequences with the least room that still fits. A run of equal
sequences is one entry of the plan, so the plan's size depends on the number
of different lengths (``capacity`` at most), not on the data. Pieces then take
the planned slots by joining on their rank within their length; ranks come from
counts per (length, salt), so the pieces of a common length never meet in one
task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkvox.llm.common import written
from sparkvox.llm.encode import ids_of
from sparkvox.session import ship_package

CAPACITY = 4096
#: Pieces per salt of a length, about: what one window holds.
PER_SALT = 20_000

#: length, first rank, pieces, first sequence, offset in the sequence.
Slot = tuple[int, int, int, int, int]


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Best fit over counts. Of a length, pieces rank, rank + 1, ... take
    sequence, sequence + 1, ... at the same offset."""
    room: dict[int, list[list[int]]] = {}  # room left -> runs [first sequence, number]
    sizes: list[int] = []  # the keys of room, sorted
    slots: list[Slot] = []
    sequences = 0

    def put(left: int, first: int, number: int) -> None:
        if left:
            if left not in room:
                room[left] = []
                bisect.insort(sizes, left)
            room[left].append([first, number])

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):  # no room anywhere: new sequences, as full as this length makes them
                each = min(capacity // length, todo)
                number = todo // each
                for x in range(each):
                    slots.append((length, rank, number, sequences, x * length))
                    rank += number
                put(capacity - each * length, sequences, number)
                sequences += number
                todo -= each * number
                continue
            left = sizes[k]
            first, number = room[left].pop()
            take = min(number, todo)
            if take < number:
                room[left].append([first + take, number - take])
            if not room[left]:
                del room[left], sizes[k]
            slots.append((length, rank, take, first, capacity - left))
            put(left - length, first, take)
            rank += take
            todo -= take
    return slots


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows, pieces, starts, lengths, crcs = [], [], [], [], []
            for r, ids in enumerate(ids_of(batch, 1, path)):
                ids = np.concatenate([ids, end]).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    part = ids[s:s + capacity]
                    rows.append(r)
                    pieces.append(k)
                    starts.append(s)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: each text's ids and the end
    id, cut every ``capacity`` ids; a null text is empty."""
    ship_package(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([d.schema["id"], T.StructField("piece", T.IntegerType())]
                          + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")])
    return d.mapInArrow(_pieces(tokenizer, end_id, capacity), schema)


def ranked(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """``pieces`` (with rid and salt) plus ``rank`` within the length, from 0:
    the place among the pieces of the same length and salt, after those of the
    salts before."""
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "pack_starts")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("rid"))
    return pieces.withColumn("own", own).join(starts, ["length", "salt"]).withColumn(
        "rank", F.col("base") + F.col("own") - 1).drop("own", "base")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) plus
    ``sequence_id`` (from 0) and ``offset``: each sequence is filled from 0
    without gaps. An empty table gives no rows; equal rows get a slot each."""
    kept = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pack_pieces")
    total = kept.count()
    salts = -(-total // PER_SALT) or 1
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int"))
    counts = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack_counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan_slots(histogram, capacity)
    spark = pieces.sparkSession
    plan = spark.createDataFrame(slots, "length long, first long, number long, sequence long, offset long")
    # At most one row per length: all runs of the length, in order of rank.
    plan = written(plan.coalesce(1).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("first", "number", "sequence", "offset"))).alias("runs")), "pack_plan")
    placed = ranked(salted, counts).join(plan, "length")
    run = F.get(F.filter("runs", lambda r: (F.col("rank") >= r["first"]) & (F.col("rank") < r["first"] + r["number"])), 0)
    return placed.withColumn("run", run).select(
        *pieces.columns, (F.col("run.sequence") + F.col("rank") - F.col("run.first")).alias("sequence_id"),
        F.col("run.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 1, capacity: int = CAPACITY,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each row of ``docs``: id, ``piece`` (from 0),
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is its end id alone. Repeated rows and null ids are
    packed like any other; other columns of ``docs`` play no part."""
    packed = pack(token_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col),
                  capacity=capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
