"""Documents as sparse vectors over a fitted vocabulary, and their truncated
singular value decomposition.

The vocabulary is fitted once (a bounded number of words, by document
frequency) and saved; later documents get vectors over the same words. The
decomposition of the documents' TF-IDF matrix finds the range of its transpose
with random vectors and power steps: tasks multiply their documents' rows with
a (words x few) matrix and back and add up the products, one aggregate sums
these, and the driver only orthonormalises words x few numbers. The last product
is few x few and gives the singular values. Documents, old or new, are placed by
one product with the saved components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvox.functions import lexicon as L
from sparkvox.operators.wordstats import doc_frequency
from sparkvox.session import scratch_path, ship_package

COMPONENTS, OVERSAMPLING, POWER_STEPS = 64, 10, 3


def fit_doc_term(words: DataFrame, docs: DataFrame, min_df: float | int = 1, max_df: float | int = 1.0,
                 vocab_size: int = L.MAX_VOCAB_SIZE) -> CountVectorizerModel:
    """The vocabulary of a corpus as a model that can be saved: the
    ``vocab_size`` words in most documents (ties alphabetical), numbered
    alphabetically. This is the bound of what the driver and the tasks hold."""
    vocab = doc_frequency(words, docs, min_df, max_df, vocab_size)
    names = sorted(r["lemma"] for r in vocab.select("lemma").collect())
    return CountVectorizerModel.from_vocabulary(names or [""], inputCol="lemmas", outputCol="features").setBinary(True)


def doc_term_vectors(words: DataFrame, docs: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """``(doc_id, features)``: the binary sparse vector of every document over
    the model's words; documents without any have an empty one."""
    lemmas = words.where(F.col("lemma") != "").groupBy("doc_id").agg(F.collect_set("lemma").alias("lemmas"))
    rows = docs.select("doc_id").join(lemmas, "doc_id", "left")
    return model.transform(rows.withColumn("lemmas", F.coalesce("lemmas", F.array().cast("array<string>")))).drop("lemmas")


def vectors_to_doc_term(vectors: DataFrame, model: CountVectorizerModel) -> DataFrame:
    """The long form ``(doc_id, lemma)`` of sparse vectors."""
    names = vectors.sparkSession.createDataFrame(list(enumerate(model.vocabulary)), "index int, lemma string")
    index = F.explode(F.unwrap_udt("features")["indices"]).alias("index")
    return vectors.select("doc_id", index).join(names, "index").select("doc_id", "lemma")


@dataclass
class TextSvd:
    """Words with their idf and components (words x k), and the k singular values, falling."""

    lemmas: list[str]
    idf: np.ndarray
    components: np.ndarray
    singular: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w, float(f), [float(x) for x in c]) for i, (w, f, c) in enumerate(zip(self.lemmas, self.idf, self.components, strict=True))]
        rows.append((-1, None, None, [float(x) for x in self.singular]))
        spark.createDataFrame(rows, "index int, lemma string, idf double, components array<double>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextSvd:
        first, *rows = spark.read.parquet(path).orderBy("index").collect()
        k = len(first["components"])
        return TextSvd([r["lemma"] for r in rows], np.array([r["idf"] for r in rows]),
                       np.array([r["components"] for r in rows]).reshape(-1, k), np.array(first["components"]))


def _weighted(words: DataFrame, docs: DataFrame, lemmas: list[str], idf: np.ndarray) -> DataFrame:
    """``(doc_id, idx, w)``: each document's row of the TF-IDF matrix, of length one; empty without words."""
    spark = words.sparkSession
    vocab = spark.createDataFrame([(w, i, float(f)) for i, (w, f) in enumerate(zip(lemmas, idf, strict=True))], "lemma string, i int, idf double")
    counts = words.join(F.broadcast(vocab), "lemma").groupBy("doc_id", "i").agg(F.count("*").alias("n"), F.first("idf").alias("idf"))
    rows = counts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("n") * F.col("idf")).alias("w")))).alias("r"))
    length = F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    # The length stands outside the function per word, so it is worked out once per document.
    lengths = F.array_repeat(length, F.size("r"))
    rows = rows.select("doc_id", F.col("r.i").alias("idx"), F.zip_with("r.w", lengths, lambda w, n: w / n).alias("w"))
    return docs.select("doc_id").join(rows, "doc_id", "left").select(
        "doc_id", F.coalesce("idx", F.array().cast("array<int>")).alias("idx"), F.coalesce("w", F.array().cast("array<double>")).alias("w"))


def _csr(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and weight of a batch's entries."""
    idx = batch.column("idx")
    rows = np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy()))
    return rows, idx.flatten().to_numpy(), batch.column("w").flatten().to_numpy()


def _times(batch: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    """The batch's rows times a matrix, some entries at a time."""
    row, col, w = _csr(batch)
    out = np.zeros((batch.num_rows, matrix.shape[1]))
    for s in range(0, len(row), 1 << 16):
        e = slice(s, s + (1 << 16))
        first = np.flatnonzero(np.diff(row[e], prepend=-1))
        out[row[e][first]] += np.add.reduceat(w[e, None] * matrix[col[e]], first, axis=0)
    return out


def _there_and_back(matrix: np.ndarray):
    """Sums of X.T (X m) over a task's rows, a row per word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(matrix.shape), np.zeros(len(matrix), bool)
        for batch in batches:
            there = _times(batch, matrix)
            row, col, w = _csr(batch)
            order = col.argsort(kind="stable")
            row, col, w = row[order], col[order], w[order]
            used[col] = True
            for s in range(0, len(row), 1 << 16):
                e = slice(s, s + (1 << 16))
                first = np.flatnonzero(np.diff(col[e], prepend=-1))
                total[col[e][first]] += np.add.reduceat(w[e, None] * there[row[e]], first, axis=0)
        yield _rows(total, np.flatnonzero(used))

    return run


def _rows(matrix: np.ndarray, kept: np.ndarray) -> pa.RecordBatch:
    flat = matrix[kept].ravel()
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * matrix.shape[1], pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), lists], names=["i", "v"])


def _squared(matrix: np.ndarray):
    """Sums of (X m).T (X m) over a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((matrix.shape[1],) * 2)
        for batch in batches:
            there = _times(batch, matrix)
            total += there.T @ there
        yield _rows(total, np.arange(len(total)))

    return run


def _summed(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """The sum over the tasks of the matrices that ``run`` yields by rows."""
    parts = rows.mapInArrow(run, "i int, v array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v"))
    out = np.zeros(shape)
    for r in sums.collect():
        out[r["i"]] = r["v"]
    return out


def fit_text_svd(words: DataFrame, docs: DataFrame, k: int = COMPONENTS, vocab_size: int = L.MAX_VOCAB_SIZE,
                 min_df: float | int = 1, max_df: float | int = 1.0, oversampling: int = OVERSAMPLING,
                 power_steps: int = POWER_STEPS, seed: int = 0) -> TextSvd:
    """The ``k`` largest singular values of the documents' TF-IDF matrix and
    the words' components. idf = ln((1 + N) / (1 + df)) + 1, rows of length one."""
    spark = words.sparkSession
    ship_package(spark)
    vocab = sorted((r["lemma"], r["df"]) for r in doc_frequency(words, docs, min_df, max_df, vocab_size).collect())
    lemmas, n = [w for w, _ in vocab], docs.count()
    idf = np.log((1 + n) / (1 + np.array([df for _, df in vocab], float))) + 1
    k = min(k, len(lemmas), n)
    if k == 0:
        return TextSvd(lemmas, idf, np.zeros((len(lemmas), 0)), np.zeros(0))
    path = scratch_path(spark, "tfidf_rows")
    _weighted(words, docs, lemmas, idf).write.parquet(path)
    rows = spark.read.parquet(path)
    wide = min(k + oversampling, len(lemmas))
    basis = np.random.default_rng(seed).normal(size=(len(lemmas), wide))
    for _ in range(1 + power_steps):
        basis, _ = np.linalg.qr(_summed(rows, _there_and_back(basis), basis.shape))
    values, turn = np.linalg.eigh(_summed(rows, _squared(basis), (wide, wide)))
    order = np.argsort(-values)[:k]
    components = basis @ turn[:, order]
    largest = components[np.abs(components).argmax(axis=0), np.arange(k)]
    return TextSvd(lemmas, idf, components * np.where(largest < 0, -1, 1), np.sqrt(np.maximum(values[order], 0)))


def place_docs(words: DataFrame, docs: DataFrame, model: TextSvd) -> DataFrame:
    """``(doc_id, embedding)``: every document's row times the components; zeros
    for documents without a word of the vocabulary."""
    ship_package(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _rows(_times(batch, model.components), np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), at.column("v")], names=["doc_id", "embedding"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return _weighted(words, docs, model.lemmas, model.idf).mapInArrow(run, f"doc_id {doc_id}, embedding array<double>")
