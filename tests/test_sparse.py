"""Aligned sub-tokens, fitted vocabulary, truncated SVD (mini_sparse)."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from sparkvox.operators import spans as SP
from sparkvox.operators import sparse as SR
from sparkvox.sources.corpus_io import persist_model

WORDS = "doc_id long, lemma string"


# --- spans ---

def cuts(rng, length, gap):
    """Disjoint spans of a text, some missing, some empty."""
    out, at = [], 0
    while at < length:
        stop = min(length, at + rng.choice([0, 1, 2, 5, 9, 200]))
        if rng.random() > gap:
            out.append((at, stop))
        at = stop + (stop == at)
    return out


@pytest.mark.parametrize("block", [1, 8, 64])
def test_overlaps_by_range_predicate(spark, block):
    rng = random.Random(block)
    words = [(d, k, a, b) for d in range(5) for k, (a, b) in enumerate(cuts(rng, rng.choice([0, 1, 50, 700]), 0.2))]
    subs = [(d, a, b, [float(d), float(a), float(rng.randrange(9))]) for d in range(6) for a, b in cuts(rng, rng.choice([1, 60, 700]), 0.1)]
    w = spark.createDataFrame(words, "doc_id long, word_id int, start long, stop long")
    s = spark.createDataFrame(subs, "doc_id long, start long, stop long, vector array<double>")
    want = Counter((d, k, tuple(v)) for d, k, a, b in words for e, x, y, v in subs if d == e and max(a, x) < min(b, y))
    assert Counter((r.doc_id, r.word_id, tuple(r.vector)) for r in SP.overlapping(w, s, block).collect()) == want
    pooled = {(r.doc_id, r.word_id): r.vector for r in SP.subtoken_pool_aligned(w, s, 3, block).collect()}
    assert len(pooled) == len(words)
    for d, k, *_ in words:
        own = [v for (e, j, v), n in want.items() if (e, j) == (d, k) for _ in range(n)]
        assert pooled[d, k] == pytest.approx(list(np.mean(own, axis=0)) if own else [0.0] * 3)


def test_pooling_moves_no_rows_of_inputs_dealt_by_document(spark):
    docs = spark.createDataFrame([(d, k, 3 * k, 3 * k + 3) for d in range(9) for k in range(9)], "doc_id long, word_id int, start long, stop long")
    docs = docs.repartition(5, "doc_id")
    subs = docs.select("doc_id", "start", "stop", F.array(F.col("start").cast("double")).alias("vector"))
    out = SP.subtoken_pool_aligned(docs, subs, 1)
    assert {(r.word_id, r.vector[0]) for r in out.collect()} == {(k, 3.0 * k) for k in range(9)}
    moved = re.findall(r"hashpartitioning\(([^)]*)\)", out._jdf.queryExecution().toString())
    assert moved and all(re.fullmatch(r"doc_id#\d+L, 5", m) for m in moved), moved


def test_pooling_keeps_words_without_keys_places_or_characters(spark):
    words = [(None, 0, 0, 4), (1, None, 0, 4), (1, 0, None, 4), (1, 1, 2, 2), (1, 2, 0, 130), (1, 2, 0, 130)]
    w = spark.createDataFrame(words, "doc_id long, word_id int, start long, stop long")
    s = spark.createDataFrame([(1, 0, 130, [3.0]), (None, 0, 130, [9.0]), (1, 129, 131, [6.0]), (1, 3, 5, None)], "doc_id long, start long, stop long, vector array<double>")
    got = Counter((r.doc_id, r.word_id, r.start, r.stop, tuple(r.vector)) for r in SP.subtoken_pool_aligned(w, s, 1).collect())
    assert got == Counter([(*r, (0.0,)) for r in words[:4]] + [(*r, (4.5,)) for r in words[4:]])


def test_places_of_words(spark):
    docs = spark.createDataFrame([(1, "ab  c é東 x"), (2, ""), (3, None), (4, "   ")], "doc_id long, text string")
    got = sorted((r.doc_id, r.word_id, r.text, r.start, r.stop) for r in SP.word_spans(docs).collect())
    assert got == [(1, 0, "ab", 0, 2), (1, 2, "c", 4, 5), (1, 3, "é東", 6, 8), (1, 4, "x", 9, 10)]


# --- vocabulary ---

def corpus(spark, n=60, seed=3):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(30)]
    rows = [(d, w) for d in range(n) for w in rng.choices(names, weights, k=rng.randrange(0, 25))]
    return rows, spark.createDataFrame([*rows, (0, "")], WORDS).repartition(4), spark.createDataFrame([(d,) for d in range(n + 1)], "doc_id long")


def test_vectors_of_a_saved_vocabulary(spark, tmp_path):
    rows, words, docs = corpus(spark)
    model = SR.fit_doc_term(words, docs, vocab_size=10)
    df = Counter(w for _, w in set(rows))
    top = sorted(sorted(df, key=lambda w: (-df[w], w))[:10])
    assert model.vocabulary == top
    again = persist_model(model, f"{tmp_path}/m")
    assert isinstance(again, CountVectorizerModel) and again.vocabulary == top and again.getBinary()
    vectors = SR.doc_term_vectors(words, docs, again)
    assert vectors.count() == docs.count()
    assert {tuple(r) for r in SR.vectors_to_doc_term(vectors, again).collect()} == {(d, w) for d, w in rows if w in top}
    later = spark.createDataFrame([(900, "w0"), (900, "unseen"), (900, "w0")], WORDS)  # documents that come later
    got = SR.doc_term_vectors(later, later.select("doc_id").distinct(), again).first().features
    assert got.size == 10 and got.indices.tolist() == [top.index("w0")] and got.values.tolist() == [1.0]
    none = words.limit(0)
    empty = SR.fit_doc_term(none, docs)
    assert SR.vectors_to_doc_term(SR.doc_term_vectors(none, docs, empty), empty).collect() == []


# --- truncated SVD ---

def matrix(rows, n, lemmas, total):
    x = np.zeros((n, len(lemmas)))
    df = Counter(w for _, w in set(rows))
    for (d, w), c in Counter(rows).items():
        if w in lemmas:
            x[d, lemmas.index(w)] = c * (math.log((1 + total) / (1 + df[w])) + 1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


@pytest.mark.parametrize("vocab", [1000, 12])
def test_singular_values_against_numpy(spark, tmp_path, vocab):
    rows, words, docs = corpus(spark)
    model = SR.fit_text_svd(words, docs, k=8, vocab_size=vocab, oversampling=4, power_steps=12)
    x = matrix(rows, 61, model.lemmas, 61)
    _, s, vt = np.linalg.svd(x)
    assert len(model.lemmas) == min(vocab, len({w for _, w in rows}))
    assert model.singular == pytest.approx(s[:8], rel=1e-4)
    assert np.abs(model.components.T @ model.components - np.eye(8)).max() < 1e-9
    model.save(spark, f"{tmp_path}/svd")
    again = SR.TextSvd.load(spark, f"{tmp_path}/svd")
    placed = {r.doc_id: r.embedding for r in SR.place_docs(words, docs, again).collect()}
    assert len(placed) == 61
    assert np.abs(np.array([placed[d] for d in range(61)]) - x @ model.components).max() < 1e-9
    # Distances in the plane of the leading components do not depend on signs.
    one, two = x @ model.components[:, :3], x @ vt[:3].T
    assert np.abs(one @ one.T - two @ two.T).max() < 1e-3


def test_later_documents_are_placed(spark):
    rows, words, docs = corpus(spark)
    model = SR.fit_text_svd(words, docs, k=4, power_steps=6)
    later = spark.createDataFrame([(7_000, w) for d, w in rows if d == 5] + [(7_001, "unseen")], WORDS)
    names = spark.createDataFrame([(7_000,), (7_001,), (7_002,)], "doc_id long")
    got = {r.doc_id: r.embedding for r in SR.place_docs(later, names, model).collect()}
    old = {r.doc_id: r.embedding for r in SR.place_docs(words, docs, model).collect()}
    assert got[7_000] == pytest.approx(old[5]) and got[7_001] == got[7_002] == [0.0] * 4


def test_svd_of_nothing(spark):
    _, words, docs = corpus(spark)
    model = SR.fit_text_svd(words.limit(0), docs)
    assert len(model.singular) == 0
    assert [len(r.embedding) for r in SR.place_docs(words, docs, model).collect()] == [0] * 61
    assert SR.place_docs(words, docs.limit(0), model).collect() == []
    same = spark.createDataFrame([(d, "a") for d in range(9)], WORDS)  # rank one
    assert SR.fit_text_svd(same, same.select("doc_id")).singular == pytest.approx([3.0])


def test_a_row_has_its_length_worked_out_once(spark):
    words = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b")], WORDS)
    rows = SR._weighted(words, words.select("doc_id").distinct(), ["a", "b"], np.array([1.0, 2.0]))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in re.findall(r"lambdafunction\((.*?), lambda", plan) if "aggregate(" in x]
    assert {r.doc_id: (r.idx, r.w) for r in rows.collect()} == {1: ([0, 1], pytest.approx([0.5 ** 0.5] * 2)), 2: ([1], [1.0])}
