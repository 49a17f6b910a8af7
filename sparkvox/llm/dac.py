"""Token files of directly addressable codes.

An id is split into chunks of bits, low bits first. Level 1 holds the first
chunk of every id; a bitmap says which ids go on, and level 2 holds the second
chunk of those, and so on. The place of an id's chunk on the next level is the
number of ids before it that go on, which a rank directory gives in one step.
So any token is read without decoding what stands before it. The chunk widths
are those that make the shard smallest.

Shards hold consecutive documents in the order of their ids; a table of shards
says where each one's tokens start in the whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkvox.llm import files
from sparkvox.llm.common import written
from sparkvox.llm.encode import ids_of
from sparkvox.session import ship_package

MAGIC = b"DAC1"
#: Tokens of a shard, about (one document is never split).
SHARD_TOKENS = 2 << 20
#: Bits between two entries of a rank directory.
RANK_STEP = 512
#: Tokens that a sequential reader takes at a time, about.
READ_TOKENS = 1 << 18


def level_widths(counts_by_length: np.ndarray) -> list[int]:
    """Chunk widths that need the fewest bits. In: number of ids by bit length (index 1 up)."""
    total = max((n for n in range(len(counts_by_length)) if counts_by_length[n]), default=1)
    longer = [int(counts_by_length[b + 1:].sum()) for b in range(total)]  # ids longer than b bits
    longer[0] = int(counts_by_length.sum())
    best: list[tuple[int, list[int]]] = [(0, [])] * (total + 1)
    for b in range(total - 1, -1, -1):
        best[b] = min((longer[b] * (w + (b + w < total)) + best[b + w][0], [w, *best[b + w][1]])
                      for w in range(1, total - b + 1))
    return best[0][1]


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another. Eight values
    fill ``width`` bytes: up to 16 bits they are put together in two 64-bit
    words, four values in each, without a byte per bit."""
    if width > 16:
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :(width + 7) // 8], axis=1, bitorder="little")
        return np.packbits(bits[:, :width], bitorder="little").tobytes()
    groups = np.zeros(-(-len(values) // 8) * 8, np.uint64)
    groups[:len(values)] = values
    groups = groups.reshape(-1, 2, 4)
    halves = groups[:, :, 0].copy()
    for k in range(1, 4):
        halves |= groups[:, :, k] << np.uint64(k * width)
    words = np.zeros((len(halves), 2), "<u8")
    words[:, 0], words[:, 1] = halves[:, 0], halves[:, 1]
    if width < 16:
        words[:, 0] |= halves[:, 1] << np.uint64(4 * width)
        words[:, 1] >>= np.uint64(64 - 4 * width)
    return words.view(np.uint8)[:, :width].tobytes()[:(len(values) * width + 7) // 8]


def _unpacked(chunks: np.ndarray, width: int, first: int, n: int) -> np.ndarray:
    """``n`` values of ``width`` bits from place ``first`` on."""
    if width > 16:
        bit = first * width
        bits = np.unpackbits(chunks[bit >> 3:(bit + n * width + 7) >> 3], bitorder="little")[bit & 7:(bit & 7) + n * width]
        value = np.zeros((n, 4), np.uint8)
        value[:, :(width + 7) // 8] = np.packbits(bits.reshape(n, width), axis=1, bitorder="little")
        return value.view("<u4")[:, 0]
    start, stop = first // 8, -(-(first + n) // 8)
    raw = np.zeros((stop - start) * width, np.uint8)
    part = chunks[start * width:stop * width]
    raw[:len(part)] = part
    words = np.zeros((stop - start, 16), np.uint8)
    words[:, :width] = raw.reshape(-1, width)
    words = words.view("<u8")
    halves = words.copy()
    if width < 16:
        halves[:, 1] = words[:, 0] >> np.uint64(4 * width) | words[:, 1] << np.uint64(64 - 4 * width)
    out = np.empty((len(words), 2, 4), np.uint32)
    for k in range(4):
        out[:, :, k] = halves >> np.uint64(k * width) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[first - 8 * start:first - 8 * start + n]


def encode_shard(docs: list[np.ndarray], ids: list[int | None]) -> bytes:
    """A shard: header, document ids, their starts, then each level's chunks, bitmap and directory."""
    tokens = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    lengths = np.frexp(tokens.astype(np.float64))[1]  # bits of each id
    widths = level_widths(np.bincount(np.maximum(lengths, 1), minlength=2))
    starts = np.cumsum([0, *map(len, docs)]).astype("<u8")
    known = np.array([i is not None for i in ids], np.uint8)
    numbers = np.array([i or 0 for i in ids], "<i8")
    parts = [MAGIC, struct.pack("<IQB", len(docs), len(tokens), len(widths)), bytes(widths),
             numbers.tobytes(), known.tobytes(), starts.tobytes()]
    left = tokens
    for k, width in enumerate(widths):
        chunks = _packed(left & np.uint32((1 << width) - 1), width)
        left = left >> np.uint32(width)
        on = left > 0
        if k == len(widths) - 1:
            bitmap, ranks = b"", b""
        else:
            bits = np.packbits(on, bitorder="little")
            bitmap = bits.tobytes()
            sums = np.add.reduceat(on, np.arange(0, len(on), RANK_STEP)) if len(on) else np.zeros(0, np.int64)
            ranks = np.concatenate([[0], np.cumsum(sums)]).astype("<u4").tobytes()
        parts += [struct.pack("<QQQ", len(chunks), len(bitmap), len(ranks)), chunks, bitmap, ranks]
        left = left[on]
    return b"".join(parts)


class Shard:
    """Random access to a shard's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("these bytes are no token shard")
        n, self.n_tokens, k = struct.unpack_from("<IQB", data, 4)
        at = 4 + struct.calcsize("<IQB")
        self.widths = list(data[at:at + k])
        at += k
        numbers = np.frombuffer(data, "<i8", n, at)
        known = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.ids = [int(i) if ok else None for i, ok in zip(numbers, known, strict=True)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        at += 9 * n + 8 * (n + 1)
        self._levels = []
        for _ in range(k):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            level = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u4"), strict=True):
                level.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
                at += size
            self._levels.append(level)

    def _rank(self, level: int, i: int) -> int:
        """Ids before place ``i`` of a level that go on to the next."""
        _, bitmap, ranks = self._levels[level]
        block = i // RANK_STEP
        bits = np.unpackbits(bitmap[block * RANK_STEP // 8:(i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(bits[:i - block * RANK_STEP].sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids at the places from ``start`` to ``stop``."""
        out = np.zeros(stop - start, np.uint32)
        places, shift, first = np.arange(stop - start), 0, start
        for k, width in enumerate(self.widths):
            chunks, bitmap, _ = self._levels[k]
            n = len(places)
            if not n:
                break
            value = _unpacked(chunks, width, first, n) << np.uint32(shift)
            if k:
                out[places] |= value
            else:
                out[:] = value
            if k == len(self.widths) - 1:
                break
            bits = np.unpackbits(bitmap[first // 8:(first + n + 7) // 8], bitorder="little")[first % 8:first % 8 + n]
            first, places, shift = self._rank(k, first), places[bits.view(bool)], shift + width
        return out

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order, a run of at least READ_TOKENS tokens (or the rest) at a time."""
        k, n = 0, len(self.ids)
        while k < n:
            end = min(n, max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + READ_TOKENS, "left"))))
            run = self.slice(int(self.starts[k]), int(self.starts[end])).astype("<u4", copy=False)
            yield from np.split(run, self.starts[k + 1:end] - self.starts[k])
            k = end

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


def _writes(folder: str, path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        ids: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, ids, held, number
            name = files.new_name(f"tokens-{part:06d}-{number:06d}", ".dac")
            with files.creating(folder, name) as out:
                out.write(encode_shard(docs, ids))
            row = pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([len(docs)], pa.int64()), pa.array([held], pa.int64())],
                names=["name", "part", "number", "n_docs", "n_tokens"])
            docs, ids, held, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), ids_of(batch, 1, path), strict=True):
                docs.append(np.append(found, np.uint32(end_id)))
                ids.append(doc_id)
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encodes ``docs`` and writes them as shards in ascending order of the
    (integer) id, null last. Gives the folder and the table of shards: name,
    place (part, number), n_docs, n_tokens, start (tokens of all shards before).

    A null or empty text is its end id alone; repeated rows are written as
    often as they occur; rows of one id follow a hash of their text, so their
    order is fixed; no rows give no shards.
    Other columns of ``docs``, whatever their names, take no part."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or files.shared_folder(spark, "tokens")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_id = F.col("id").asc_nulls_last()
    ordered = d.repartitionByRange(n, by_id).sortWithinPartitions(by_id, F.xxhash64("text"))
    shards = written(ordered.mapInArrow(_writes(folder, tokenizer, end_id, shard_tokens),
                                        "name string, part int, number int, n_docs long, n_tokens long"), "token_shards")
    # One row per SHARD_TOKENS tokens: few enough for one running sum.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return folder, written(shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token_table")


def _reads(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.opening(folder, name) as source:
                    shard = Shard(source.read())
                sums = [zlib.crc32(x) for x in shard.documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ids, pa.int64()), pa.array(shard.starts[:-1] + base),
                     pa.array(np.diff(shard.starts)), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(folder: str, shards: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Each document of the shards: id, ``start`` (tokens of all documents
    before), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit numbers)."""
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (shards.select("name", "start").repartition(n)
            .mapInArrow(_reads(folder), "id long, start long, n_tokens long, ids_crc32 long")
            .withColumnRenamed("id", id_col))
