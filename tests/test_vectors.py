"""mini_vectors: cosine edge cases and pooling (mean of means)."""

import numpy as np
import pytest

from sparkvox.functions import vectors as V
from sparkvox.operators import vectors as VC
from sparkvox.operators.docmap import document_map_2d, kmeans_all_k, l2_normalize, nearest_centroid


def test_cosine_cases(spark):
    df = spark.createDataFrame(
        [(0, [0.0, 0.0], [1.0, 0.0]), (1, [1.0, 2.0], [2.0, 4.0]), (2, [1.0, 0.0], [-1.0, 0.0]), (3, [1.0, 0.0], [0.0, 3.0])],
        "id int, a array<double>, b array<double>",
    )
    got = {r.id: r.c for r in df.select("id", V.cosine("a", "b").alias("c")).collect()}
    assert got[0] is None
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(-1.0) and got[3] == pytest.approx(0.0)
    z = l2_normalize(df.select("a").limit(1), "a").first().a
    assert z == [None, None]


def test_pool_mean_of_means(spark):
    # sentence 0: [0], [2] -> 1 ; sentence 1: [10] -> 10 ; doc = 5.5 (not 4)
    df = spark.createDataFrame([(1, 0, [0.0]), (1, 0, [2.0]), (1, 1, [10.0])], "doc_id long, sent_id int, vector array<double>")
    assert VC.pool_vectors(df).first().vector == [pytest.approx(5.5)]


def test_subtoken_pool_zero_fallback(spark):
    words = spark.createDataFrame([(1,), (2,)], "word_id long")
    sub = spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "word_id long, vector array<double>")
    got = {r.word_id: r.vector for r in VC.subtoken_pool(words, sub, 2).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_similar_docs_and_centroids(spark):
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>"
    )
    targets = corpus.filter("vec_id = 1")
    top = [(r.id, r.rank) for r in VC.similar_docs(corpus, targets, 2).orderBy("rank").collect()]
    assert top == [(4, 1), (2, 2)]  # self excluded, ties by id
    cents = spark.createDataFrame([(7, [1.0, 0.0]), (9, [0.0, 1.0])], "label int, vector array<double>")
    got = {r.vec_id: r.label for r in nearest_centroid(corpus, cents).collect()}
    assert got == {1: 7, 2: 7, 3: 9, 4: 7}


def test_projection_matches_numpy(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "id int, v array<double>")
    got = {r.id: r.v for r in VC.random_projection(df, "v", 2, 3, method="sign").collect()}
    assert got[1] == pytest.approx(list(np.array([1.0, 2.0, 3.0]) @ VC.sign_matrix(3, 2))) and got[2] is None


def test_sign_matrix_projects_well():
    m = VC.sign_matrix(768, 96)
    c = np.corrcoef(m.T) - np.eye(96)
    assert np.abs(c).max() < 0.2
    assert np.linalg.svd(m, compute_uv=False).min() > 1.5


def test_kmeans_and_map_invariants(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n = emb.count()
    km = kmeans_all_k(emb, max_cluster=4)
    rows = km.collect()
    assert len(rows) == n * 3
    for r in rows:
        assert 0 <= r.label < r.k
    with pytest.raises(ValueError):
        kmeans_all_k(emb, max_cluster=1)
    xy = np.array([(r.x, r.y) for r in document_map_2d(emb).collect()])
    assert xy.shape == (n, 2)
    c = np.corrcoef(xy[:, 0], xy[:, 1])[0, 1]
    assert abs(c) < 1e-6  # principal axes are uncorrelated


def test_similar_docs_in_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.1, 0.9]), (5, [0.0, 0.0]), (6, None)],
        "vec_id long, embedding array<double>",
    )
    whole = sorted(tuple(r) for r in VC.similar_docs(corpus, corpus, 1).collect())
    monkeypatch.setattr(VC, "BLOCK_ROWS", 1)
    blocks = sorted(tuple(r) for r in VC.similar_docs(corpus, corpus, 1).collect())
    assert whole == blocks and len(whole) == 4
    assert {(t, i) for t, i, _s, _r in whole} == {(1, 2), (2, 1), (3, 4), (4, 3)}
    assert VC.similar_docs(corpus, corpus.filter("vec_id > 4"), 1).count() == 0


def test_similar_docs_many_targets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.target_id: r.id for r in VC.similar_docs(df.filter("vec_id < 300"), df, 1).collect()}
    assert len(got) == 20_000
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for t in range(0, 20_000, 997):
        sims = u[:300] @ u[t]
        sims[t if t < 300 else []] = -2
        assert got[t] == int(sims.argmax())


def test_vectors_without_direction(spark):
    rows = [(i, [1.0 + i, 1.0]) for i in range(10)] + [(i, [-1.0, 1.0 * i]) for i in range(10, 20)] + [(90, [0.0, 0.0]), (91, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    labels = kmeans_all_k(df, max_cluster=3).collect()
    assert len(labels) == 2 * len(rows)
    assert {r.vec_id for r in labels if r.label is None} == {90, 91}
    xy = {r.vec_id: (r.x, r.y) for r in document_map_2d(df).collect()}
    assert len(xy) == len(rows) and xy[90] == xy[91] == (None, None) and xy[3][0] is not None
    cents = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "label int, vector array<double>")
    near = {r.vec_id: r.label for r in nearest_centroid(df, cents).collect()}
    assert near[90] is None and near[91] is None and near[9] == 0
    tie = spark.createDataFrame([(1, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert nearest_centroid(tie, cents).first().label == 1


def test_digits_of_a_word_are_read_together(spark):
    """Every component is a digit of the md5, whatever their number; eight digits take one conversion."""
    import hashlib

    words = spark.createDataFrame([(w,) for w in ("cat", "", "粲", "Ünï", None)], "lemma string")
    for dim in (1, 7, 8, 9, 32):
        out = VC.hashed_word_vectors(words, dim)
        want = {w: [int(c, 16) - 7.5 for c in hashlib.md5(w.encode()).hexdigest()[:dim]] for w in ("cat", "", "粲", "Ünï")} | {None: [None] * dim}
        assert {r.lemma: r.vector for r in out.collect()} == want
        pieces = out._jdf.queryExecution().analyzed().toString().split("substring(")
        assert len({p.split(",")[1] for p in pieces[1:]}) == -(-dim // 8)
