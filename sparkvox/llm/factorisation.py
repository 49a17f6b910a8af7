"""Quality classifier: a factorisation machine over hashed words, statistics of
a text's structure and metadata.

Every document is a sparse vector: hashed words (square roots of their counts,
of length one together), the structure statistics (each by its value and by
the bin it falls in, of length one together at most) and the metadata's bins. The
machine has a weight per slot and, per slot, a short vector whose products with
the other slots' vectors weigh all pairs. The pairs are never listed: the sum
over pairs is half of (square of the sum less sum of the squares) per factor,
linear in the slots of a document.

Documents are turned into slots where their text is read; no text is shuffled.
The machine is fitted on a bounded sample of labelled rows and goes with the
tasks that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvox.llm import hashing
from sparkvox.llm.common import unused, written
from sparkvox.session import ship_package

#: The bounds of the fit: labelled rows, and slots of these together (some 20 bytes each on the driver).
MAX_LABELLED, MAX_SLOTS = 20_000, 8_000_000
WORD_BITS, META_BITS, BIGRAM_BITS = 18, 10, 20
BINS = 24
FACTORS, EPOCHS, BATCH, RATE = 8, 10, 128, 0.15
#: Shrinking of weights and of factors per step.
DECAY = 2e-4
#: A word must occur in so many sampled documents to have a weight.
LEAST_DOCUMENTS = 3

#: Classes of bytes whose shares are statistics: upper-case and lower-case
#: letters, digits, sentence marks, commas, exclamation marks, bars, symbols,
#: other ASCII marks, bytes beyond ASCII, line ends; the rest (class 0) is space and control.
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".?", ",;:", "!", "|", "#*$%&<>",
            "\"'()+-/=@[\\]^_`{}~")
_BEYOND, _LINE_END = len(_CLASSES) + 1, len(_CLASSES) + 2
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k + 1
_CLASS[0x80:] = _BEYOND
_CLASS[0x0A] = _LINE_END
_N_CLASSES = _LINE_END + 1

#: Statistics: class shares, then words, bytes a word, words a line, and the shares of
#: distinct words, of the most frequent word, of repeated word pairs and of words equal to the one before.
N_STATS = _N_CLASSES - 1 + 7
_STATS_AT = 1 << WORD_BITS
_META_AT = _STATS_AT + N_STATS * (BINS + 1)
SLOTS = _META_AT + (1 << META_BITS)

#: Document, slot, value; sorted by document and slot.
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """First row, offsets of the rows' parts, and whether this goes on with the
    row before: runs of whole rows, or parts of a row that is long by itself."""
    for i, j in hashing.row_groups(offsets, hashing.GROUP_BYTES):
        if offsets[j] - offsets[i] <= hashing.GROUP_BYTES:
            yield i, offsets[i:j + 1], False
        else:
            for s, e in hashing._segments(data, int(offsets[i]), int(offsets[j])):
                yield i, np.array([s, e]), s > offsets[i]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(keys) == 1:
        return keys[0], counts[0]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def _binned(values: np.ndarray, stat: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and scaled value of a statistic: shares by their square root, counts by their logarithm."""
    scaled = np.sqrt(values) if stat < _N_CLASSES - 1 or stat >= N_STATS - 4 else np.log2(1 + values) / BINS
    scaled = np.clip(scaled, 0, 1)
    return np.minimum((scaled * BINS).astype(np.int64), BINS - 1), scaled


def text_slots(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Slots of words and structure of each text. Long texts are worked through in parts; what is
    kept of one is its distinct words."""
    n = len(offsets) - 1
    classes = np.zeros((n, _N_CLASSES), np.int64)
    words, again = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found: dict[str, tuple[list, list]] = {"word": ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]),
                                           "pair": ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])}
    last = None
    for first, own, further in _pieces(data, offsets):
        rows = len(own) - 1
        row = np.repeat(np.arange(rows), np.diff(own))
        classes[first:first + rows] += np.bincount(
            row * _N_CLASSES + _CLASS[data[own[0]:own[-1]]], minlength=rows * _N_CLASSES).reshape(rows, -1)
        h, row = hashing.word_hashes(data, own, lower=True)
        words[first:first + rows] += np.bincount(row, minlength=rows)
        before = np.r_[np.uint64(last if further and last is not None else 0), h[:-1]][:len(h)]
        paired = np.r_[further and last is not None, row[1:] == row[:-1]][:len(h)].astype(bool)
        pair = hashing.mix(h + before * np.uint64(0x9E3779B97F4A7C15))[paired]
        again[first:first + rows] += np.bincount(row[paired & (h == before)], minlength=rows)
        last = h[-1] if len(h) else last if further else None
        for name, hashes, r, bits in (("word", h, row, WORD_BITS), ("pair", pair, row[paired], BIGRAM_BITS)):
            key, count = np.unique((r + first << bits) | (hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            found[name][0].append(key)
            found[name][1].append(count)
    key, count = _merged(*found["word"])
    row, slot = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    distinct, most = np.bincount(row, minlength=n), np.zeros(n)
    np.maximum.at(most, row, count)
    value = np.sqrt(count / np.maximum(words, 1)[row])
    pairs = np.bincount(_merged(*found["pair"])[0] >> BIGRAM_BITS, minlength=n)
    size = np.maximum(classes[:, 1:].sum(axis=1), 1)
    lines = classes[:, _LINE_END] + 1
    some = np.maximum(words, 1)
    stats = [*(classes[:, k] / size for k in range(1, _N_CLASSES)), words, size / some, words / lines,
             distinct / some, most / some, np.where(words > 1, 1 - pairs / np.maximum(words - 1, 1), 0),
             again / some]
    rows, slots, values = [row], [slot], [value]
    each = 1 / np.sqrt(2 * N_STATS)
    for k, s in enumerate(stats):
        which, scaled = _binned(s, k)
        at = _STATS_AT + k * (BINS + 1)
        rows += [np.arange(n)] * 2
        slots += [at + which, np.full(n, at + BINS)]
        values += [np.full(n, each), scaled * each]
    return tuple(map(np.concatenate, (rows, slots, values)))


def _batch_slots(batch: pa.RecordBatch, text_at: int, meta_at: int) -> Iterator[tuple[int, int, Sparse]]:
    """Slots of a batch's rows, a few megabytes of text at a time, sorted by row and slot."""
    data, offsets = hashing.text_bytes(batch.column(text_at))
    meta = batch.column(meta_at)
    bins = meta.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(bins) // max(len(meta), 1)
    for i, j in hashing.row_groups(offsets, hashing.GROUP_BYTES):
        row, slot, value = text_slots(data, offsets[i:j + 1])
        own = bins[i * width:j * width]
        row = np.concatenate([row, np.repeat(np.arange(j - i), width)])
        slot = np.concatenate([slot, _META_AT + own])
        value = np.concatenate([value, np.full(len(own), 1 / np.sqrt(2 * N_STATS))])
        order = np.lexsort((slot, row))
        yield i, j, (row[order], slot[order], value[order])


def metadata_bins(docs: DataFrame, columns: list[str]) -> Column:
    """A bin per metadata column, null having one of its own: numbers by the
    logarithm of their size, anything else by a hash of its text."""
    bins = []
    for k, c in enumerate(columns):
        number = isinstance(docs.schema[c].dataType, T.NumericType)
        x = F.col(c).cast("double")
        bin_ = F.floor(F.log2(1 + F.abs(x))) * F.when(x < 0, -1).otherwise(1) if number else F.xxhash64(F.col(c).cast("string"))
        bins.append(F.pmod(F.xxhash64(F.lit(k), F.coalesce(bin_.cast("long"), F.lit(-(1 << 62)))), F.lit(1 << META_BITS)))
    return F.array(*bins).cast("array<int>")


@dataclass
class Machine:
    """Bias, weights (SLOTS) and factors (SLOTS x FACTORS)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, found: Sparse, n: int) -> np.ndarray:
        """Log-odds per document; pairs by the square of the sum less the sum of the squares."""
        row, slot, value = found
        out = self.bias + np.bincount(row, self.weights[slot] * value, n)
        v = self.factors[slot] * value[:, None]
        out -= np.bincount(row, (v * v).sum(axis=1), n) / 2
        for f in range(v.shape[1]):
            out += np.bincount(row, v[:, f], n) ** 2 / 2
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """The slots in use as a small Parquet table."""
        used = np.flatnonzero((self.weights != 0) | (self.factors != 0).any(axis=1))
        rows = [(int(s), float(self.weights[s]), [float(x) for x in self.factors[s]]) for s in used]
        rows.append((-1, float(self.bias), [0.0] * self.factors.shape[1]))
        spark.createDataFrame(rows, "slot int, weight double, factors array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Machine:
        rows = spark.read.parquet(path).collect()
        out = Machine(0.0, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, len(rows[0]["factors"])), np.float32))
        for r in rows:
            if r["slot"] < 0:
                out.bias = r["weight"]
            else:
                out.weights[r["slot"]], out.factors[r["slot"]] = r["weight"], r["factors"]
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fitted(documents: list[Sparse], target: np.ndarray, *, factors: int = FACTORS, epochs: int = EPOCHS, batch: int = BATCH,
           rate: float = RATE, decay: float = DECAY, seed: int = 0) -> Machine:
    """Minimises logistic loss by adaptive gradient steps over fixed random
    batches; ``documents`` holds (ignored, slots, values) of each document. The
    same input gives the same machine. Without two classes the machine has only a bias."""
    machine = Machine(0.0, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, factors), np.float32))
    n, mean = len(target), float(np.mean(target)) if len(target) else 0.5
    share = (mean * n + 0.5) / (n + 1)
    machine.bias = float(np.log(share / (1 - share)))
    if n == 0 or target.min() == target.max():
        return machine
    seen = np.zeros(SLOTS, np.int64)
    for _, slot, _ in documents:
        seen[np.unique(slot)] += 1
    used = np.flatnonzero((seen >= LEAST_DOCUMENTS) | ((np.arange(SLOTS) >= _STATS_AT) & (seen > 0)))
    place = np.full(SLOTS, -1, np.int32)
    place[used] = np.arange(len(used))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), factors))
    gw, gv, gb, bias = np.full(len(used), 1e-4), np.full((len(used), factors), 1e-4), 1e-4, machine.bias
    batches = []
    order = rng.permutation(n)
    for s in range(0, n, batch):
        own = order[s:s + batch]
        at = [place[documents[i][1]] for i in own]
        slot = np.concatenate(at)
        kept = slot >= 0
        row = np.repeat(np.arange(len(own), dtype=np.int32), [len(a) for a in at])[kept]
        value = np.concatenate([documents[i][2] for i in own])[kept].astype(np.float32)
        by_slot = slot[kept].argsort(kind="stable")
        row, slot, value = row[by_slot], slot[kept][by_slot], value[by_slot]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        batches.append((row, slot, value, first, target[own]))
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            row, slot, value, first, y = batches[b]
            vx = v[slot] * value[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], len(y)) for f in range(factors)], axis=1)
            z = bias + np.bincount(row, w[slot] * value, len(y)) + ((sums**2).sum(axis=1) - np.bincount(row, (vx * vx).sum(axis=1), len(y))) / 2
            g = (_sigmoid(z) - y) / len(y)
            slope = g[row] * value
            own = slot[first]
            dw = np.add.reduceat(slope, first) + decay * w[own]
            dv = np.add.reduceat(slope[:, None] * (sums[row] - vx), first, axis=0) + decay * v[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            gb += g.sum() ** 2
            w[own] -= 4 * rate * dw / np.sqrt(gw[own])
            v[own] -= rate * dv / np.sqrt(gv[own])
            bias -= rate * g.sum() / np.sqrt(gb)
    machine.bias = float(bias)
    machine.weights[used], machine.factors[used] = w, v
    return machine


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash, digest, target, text, metadata bins -> hash, digest, target, slots, values."""
    for batch in batches:
        for i, j, (row, slot, value) in _batch_slots(batch, 3, 4):
            ends = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, j - i) for k in range(3)),
                 pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))], names=["h", "t", "y", "slots", "vals"])


def learn(docs: DataFrame, labels: DataFrame, *, chosen: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", metadata: tuple[str, ...] = (), max_labelled: int = MAX_LABELLED,
          max_slots: int = MAX_SLOTS, **how) -> Machine:
    """A machine for the chance that ``label_col`` is 1, learned from the
    labelled documents whose id meets ``chosen`` (an expression on ``id_col``).

    Of these it takes those of the least hash of the id, ``max_labelled``
    documents and ``max_slots`` slots at most: the bound of the fit. Only their
    slots reach the driver; no text is shuffled. Null ids and labels, and labels
    outside 0 to 1, are no examples; an id with several labels counts with their
    mean; documents of one id and text count once."""
    spark = docs.sparkSession
    ship_package(spark)
    key = F.col(id_col)
    labelled = (labels.where(key.isNotNull() & F.col(label_col).between(0, 1) & (F.lit(True) if chosen is None else chosen))
                .groupBy(key.alias("i")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
                .select("i", "y", F.xxhash64("i").alias("h")))
    labelled = written(labelled, "labelled")
    count = labelled.count()
    if count > max_labelled:  # a share of the hashes that more than max_labelled ids meet with a chance of 1 in 10,000
        share = max(max_labelled - 4 * max_labelled**0.5, 1) / count
        labelled = labelled.where(F.col("h") < int(-(2**63) + share * 2**64))
    texts = docs.select(key.alias("i"), F.col(text_col).cast("string").alias("x"), metadata_bins(docs, list(metadata)).alias("m"))
    # max_labelled rows at most, so they may be broadcast and no text moves.
    rows = (texts.join(F.broadcast(labelled), "i").select("h", F.xxhash64("x", "m").alias("t"), "y", "x", "m")
            .mapInArrow(_sampled, "h long, t long, y double, slots array<int>, vals array<float>")
            .groupBy("h", "t").agg(F.first("y").alias("y"), F.first("slots").alias("slots"), F.first("vals").alias("vals")))
    rows = written(rows, "labelled_slots")
    sizes = sorted((r["h"], r["t"], r["n"]) for r in rows.select("h", "t", F.size("slots").alias("n")).collect())
    inside = np.cumsum([n for *_, n in sizes]) <= max_slots
    kept = int(min(inside.sum(), max_labelled))
    if not kept:
        return fitted([], np.zeros(0), **how)
    found = rows.where(F.col("h") <= sizes[kept - 1][0]).toArrow().combine_chunks().sort_by([("h", "ascending"), ("t", "ascending")])
    found = found.slice(0, kept)
    pairs = zip(_lists(found["slots"]), _lists(found["vals"]), strict=True)
    return fitted([(None, s, v) for s, v in pairs], found["y"].to_numpy(), **how)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        flat, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return out


def _scored(machine: Machine, text_at: int, kept: list[int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([np.zeros(0), *(_sigmoid(machine.margins(found, j - i))
                                                   for i, j, found in _batch_slots(batch, text_at, batch.num_columns - 1))])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=names)

    return run


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", metadata: tuple[str, ...] = (),
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all unless given) plus ``score``, the chance from 0 to 1
    that the label is 1, and ``predicted`` (1 from 0.5 on). No shuffle.

    Whole texts and the ``metadata`` columns that the machine was learned with
    decide, nothing else. Null texts score as empty ones, which have the score
    of their structure (no words, no lines); null metadata has a bin of its
    own. Equal texts and metadata score alike, wherever and however often they
    occur. An empty table stays empty. Very long texts are worked through in
    parts; what is kept of one is its distinct words. Columns of ``docs`` named
    like the added ones stay; the added ones get underscores. A machine learned
    without two classes gives every text the labels' share."""
    ship_package(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    found, sure, bins = unused(docs, "score", "predicted", "_bins")
    sent = docs if keep == docs.columns else docs.select(*dict.fromkeys([*keep, text_col, *metadata]))
    sent = sent.withColumn(bins, metadata_bins(docs, list(metadata)))
    fields = {f.name: f for f in docs.schema.fields}
    schema = T.StructType([*(fields[c] for c in keep), T.StructField(found, T.DoubleType()), T.StructField(sure, T.IntegerType())])
    return sent.mapInArrow(_scored(machine, sent.columns.index(text_col), [sent.columns.index(c) for c in keep], schema.names), schema)
