"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary n-gram classifier per bit
tells the languages that have the bit from those that have not; a text gets a
margin from each, and its language is the one whose codeword lies nearest by
loss, each bit weighing as much as its classifier can be trusted. A text that
two codewords are nearly as close to is flagged as ambiguous.

The n-grams are hashed byte trigrams of whole texts. Their counts per language
come from one aggregate over all labelled rows; only these counts (BUCKETS per
language) and the classifiers' error counts reach the driver.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvox.llm import encode, hashing
from sparkvox.llm.common import unused
from sparkvox.session import ship_package

#: Size of the n-gram space: the bound of the model per language.
BUCKETS = 1 << 14
UNKNOWN = "und"
#: Two nearest codewords whose share of belief is below this are ambiguous.
AMBIGUOUS_BELOW = 0.6
#: Steepness of the loss, and from loss to belief.
STEEPNESS, BELIEF = 4.0, 1.0

_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Letters, as bytes: a-z (A-Z becomes that) and everything beyond ASCII; all else is one space.
_LETTER = np.full(256, 32, np.uint32)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_HAS_LETTER = regex.compile(r"\p{L}")


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram of one text; runs of other characters than
    letters are one space, as are the text's ends."""
    x = _LETTER[data]
    space = x == 32
    x = np.concatenate([[32], x[~(space & np.r_[True, space[:-1]])], [32]]).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = x[:-2] * np.uint32(_FACTORS[0]) + x[1:-1] * np.uint32(_FACTORS[1]) + x[2:] * np.uint32(_FACTORS[2])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Trigrams of a text, a bounded piece at a time; pieces overlap by two bytes."""
    step = hashing.SEGMENT
    if len(data) <= step:
        yield trigrams(data)
        return
    for s in range(0, len(data), step):
        yield trigrams(data[max(0, s - 2):s + step])


def codebook(n: int) -> np.ndarray:
    """Codewords of -1 and 1 for ``n`` languages. Few languages: all ways to
    split them in two, the exhaustive code; else about 10 log2(n) random splits,
    of 200 seeded draws that with the largest least distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T
    rng = random.Random(n)
    width, best, most = int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        m = np.array([[rng.choice((-1, 1)) for _ in range(width)] for _ in range(n)], np.int8)
        if (abs(m.sum(axis=0)) == n).any():
            continue
        agree = m.astype(int) @ m.T
        least = int((width - agree[~np.eye(n, dtype=bool)].max()) // 2)
        if least > most:
            best, most = m, least
    return best


@dataclass
class Model:
    """Languages, codewords (languages x bits), weights (BUCKETS x bits), and
    the trust in each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray) -> np.ndarray:
        """Mean log-odds per trigram and bit; zeros where there is none."""
        total, n = np.zeros(self.code.shape[1]), 0
        for grams in _pieces(data):
            n += len(grams)
            counts = np.bincount(grams, minlength=BUCKETS) if len(grams) > BUCKETS // 4 else None
            total += counts @ self.weights if counts is not None else self.weights[grams].sum(axis=0)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, belief in it, and whether it is ambiguous, per row of margins."""
        z = margins[:, None, :] * self.code[None] * STEEPNESS
        loss = (np.logaddexp(0, -z) * self.trust).sum(axis=2) * (BELIEF * self.code.shape[1] / self.trust.sum())
        belief = np.exp(loss.min(axis=1, keepdims=True) - loss)
        belief /= belief.sum(axis=1, keepdims=True)
        two = np.sort(belief, axis=1)[:, -2:].sum(axis=1)
        best = belief.argmax(axis=1)
        score = belief[np.arange(len(best)), best]
        return best, score, score < AMBIGUOUS_BELOW * two


def _counts(languages: list[str]):
    place = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.release()
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(1))
            for r, lang in enumerate(batch.column(0).to_pylist()):
                for grams in _pieces(data[offsets[r]:offsets[r + 1]]):
                    counts[place[lang]] += np.bincount(grams, minlength=BUCKETS)
        k, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(counts[k, g])],
                                         names=["k", "g", "n"])

    return run


def _errors(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.release()
        place = {lang: k for k, lang in enumerate(model.languages)}
        wrong = np.zeros((len(model.languages), model.code.shape[1]), np.int64)
        seen = np.zeros(len(model.languages), np.int64)
        for batch in batches:
            data, offsets = hashing.text_bytes(batch.column(1))
            for r, lang in enumerate(batch.column(0).to_pylist()):
                k = place[lang]
                wrong[k] += model.margins(data[offsets[r]:offsets[r + 1]]) * model.code[k] <= 0
                seen[k] += 1
        k, b = np.indices(wrong.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array(wrong.ravel()),
             pa.array(np.repeat(seen, wrong.shape[1]))], names=["k", "b", "wrong", "seen"])

    return run


def train(docs: DataFrame, chosen: Column, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from all rows for which ``chosen`` holds and that have a text and
    a language. A language weighs the same however many rows it has."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.where(chosen & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    code = codebook(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1]))
    found = (rows.mapInArrow(_counts(languages), "k int, g int, n long")
             .groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["k"], found["g"]] = found["n"]
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]):
        one, other = code[:, b] > 0, code[:, b] < 0
        if one.any() and other.any():
            weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[other].mean(axis=0))
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape[1]))
    e = (rows.mapInArrow(_errors(model), "k int, b int, wrong long, seen long")
         .groupBy("k", "b").agg(F.sum("wrong").alias("wrong"), F.sum("seen").alias("seen")).toPandas())
    rate = ((e["wrong"] + 0.5) / (e["seen"] + 1.0)).groupby(e["b"]).mean().sort_index().to_numpy()
    # The weight that boosting gives a classifier of this error rate, and a little to all.
    model.trust = np.maximum(0.5 * np.log((1 - rate) / rate), 0.05)
    return model


def _predicted(model: Model, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.release()
        for batch in batches:
            column = batch.column(text_at)
            data, offsets = hashing.text_bytes(column)
            some = np.array([t is not None and _HAS_LETTER.search(t) is not None for t in column.to_pylist()], bool)
            langs, scores, unsure = [UNKNOWN] * len(some), np.zeros(len(some)), np.zeros(len(some), bool)
            if model.languages and some.any():
                at = np.flatnonzero(some)
                margins = np.array([model.margins(data[offsets[r]:offsets[r + 1]]) for r in at])
                best, score, close = model.decode(margins)
                scores[at], unsure[at] = score, close
                for r, k in zip(at, best, strict=True):
                    langs[r] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)], names=names)

    return run


def identify(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    Whole texts decide, nothing else. A text that is null, empty or without a
    letter is ``und`` with score 0, as is every text if nothing was learned.
    An empty table stays empty. Columns that ``docs`` has under these names
    stay; the added ones get underscores. ``text_col`` must be a string."""
    ship_package(docs.sparkSession)
    pred, score, unsure = unused(docs, "lang_pred", "score", "ambiguous")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()),
                           T.StructField(score, T.DoubleType()), T.StructField(unsure, T.BooleanType())])
    return docs.mapInArrow(_predicted(model, docs.columns.index(text_col), schema.names), schema)


def held_out(id_col: str = "doc_id", modulus: int = 4, residue: int = 2) -> Column:
    """Whether the checksum of the id as text leaves the residue; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == residue, F.lit(False))
