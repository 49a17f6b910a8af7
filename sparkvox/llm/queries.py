"""One query per operator over its whole intended table, and the SQL that
gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvox.llm import (
    chunk_dedup,
    dac,
    factorisation,
    langid,
    line_dedup,
    minhash,
    mixing,
    packing,
    pitman_yor,
    rules,
    vector_codes,
    warc,
    whitening,
)
from sparkvox.llm.common import table, written

#: The word tokenizer of the contract, by its file's name among the public tokenizers.
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_mix_sources", mixing.oracle_sql())
def op1(spark, d):
    """The corpus mixed by the square root of each source's size."""
    return mixing.mix_sources(table(spark, d, "documents"))


@query("op2_pitman_yor")
def op2(spark, d):
    return pitman_yor.score_documents(table(spark, d, "documents"), pitman_yor.held_out())


@query("op3_dedup_lines", line_dedup.oracle_sql())
def op3(spark, d):
    """Documents without the lines that five or more sources share."""
    return line_dedup.dedup_lines(table(spark, d, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op4_output_codes")
def op4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~langid.held_out())
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op5_chunk_recipes", chunk_dedup.ORACLE_SQL)
def op5(spark, d):
    return chunk_dedup.exact_duplicates(table(spark, d, "documents"))


@query("op6_one_permutation")
def op6(spark, d):
    return minhash.near_duplicates(table(spark, d, "documents")).drop("stays", "text_md5")


@query("op7_decision_list")
def op7(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = rules.learn_rules(docs, table(spark, d, "labels"))
    return rules.quality_rules(docs, found).select("doc_id", *rules.BASE, "base_failed", "kept", "rule")


@query("op8_token_codes")
def op8(spark, d):
    folder, shards = dac.write_tokens(table(spark, d, "documents"), tokenizer_path())
    return dac.read_tokens(folder, shards)


@query("op9_warc", warc.ORACLE_SQL)
def op9(spark, d):
    folder, archives = warc.write_archives(table(spark, d, "pages"))
    return warc.read_archives(*warc.normalise_archives(folder, archives))


@query("op10_best_fit")
def op10(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), tokenizer_path())


@query("op11_factorisation")
def op11(spark, d):
    docs, metadata = table(spark, d, "documents").select("doc_id", "text", "n_chars"), ("n_chars",)
    held = langid.held_out(modulus=3, residue=1)
    machine = factorisation.learn(docs, table(spark, d, "labels"), chosen=~held, metadata=metadata)
    found = factorisation.score(docs, machine, metadata=metadata, keep=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op12_gnat_codes", vector_codes.oracle_sql())
def op12(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    books = vector_codes.fit(vectors)
    codes = written(vector_codes.compress(vectors, books), "vector_codes")
    return vector_codes.errors_by_label(codes).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


@query("op13_qdwh_whitening")
def op13(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    return whitening.components(whitening.whiten(vectors, model), model)
