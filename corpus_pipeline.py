"""A training corpus from raw documents: language identification, line
deduplication, near-duplicate removal, mixing of sources, packing.

Each stage takes the documents that the one before kept, written as Parquet
and read again, so a stage that fails starts from a finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvox.llm import langid, line_dedup, minhash, mixing, packing
from sparkvox.llm.common import table, words, written
from sparkvox.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled rows name; texts without a
    letter and ambiguous ones go. A missing language is filled in."""
    model = langid.train(docs, ~langid.held_out())
    found = langid.identify(docs, model)
    pred, _, unsure = found.columns[len(docs.columns):]
    kept = found.where((F.col(pred) != langid.UNKNOWN) & ~F.col(unsure))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; those left without
    a word go if they had one before."""
    found = line_dedup.dedup_lines(docs)
    gone = found.columns[-1]
    kept = found.where((F.col(gone) == 0) | (F.size(words(F.col("text"))) > 0))
    points = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", points).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated to the sources' target weights, shuffled."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language identification", identify_language),
    ("line deduplication", remove_boilerplate),
    ("near-duplicate removal", remove_near_duplicates),
    ("source mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the language model nor the packing; tests/llm compares every stage with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage_" + name.replace(" ", "_"))
    return docs
