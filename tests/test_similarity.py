"""Similarity join by hyperplane buckets (mini_similarity)."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvox.operators import similarity as SI
from sparkvox.operators import vectors as VC

VECTORS = "vec_id long, embedding array<double>"


def made(rng, n, dims, groups):
    """Random vectors, and groups of (size, angle) around one of their own."""
    rows = [rng.normal(size=dims) for _ in range(n)]
    for size, angle in groups:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            off = rng.normal(size=dims)
            off -= off @ centre * centre
            rows.append((centre * math.cos(angle) + off / np.linalg.norm(off) * math.sin(angle)) * rng.uniform(0.5, 3))
    order = rng.permutation(len(rows))
    return [(int(k), [float(x) for x in rows[i]]) for k, i in enumerate(order)]


def cosines(a, b):
    a, b = (np.array([v for _, v in r]) for r in (a, b))
    return (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T


def test_band_plan_reaches_its_recall():
    for n in (10, 1000, 10**6, 10**9):
        for t in (0.3, 0.7, 0.9, 0.99, 1.0):
            bits, bands = SI.band_plan(n, t)
            same = 1 - math.acos(t) / math.pi
            assert 1 - (1 - same**bits) ** bands >= SI.RECALL - 1e-9
    assert SI.band_plan(10**9, 0.9)[0] > SI.band_plan(10**3, 0.9)[0]


@pytest.mark.parametrize("block", [512, 16])
def test_links_against_all_pairs(spark, monkeypatch, block):
    """Small blocks cut large buckets; the links stay."""
    monkeypatch.setattr(SI, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = made(rng, 600, 24, [(150, 0.15), (40, 0.2), (5, 0.1)])
    rows += [(1000 + k, rows[7][1]) for k in range(300)]  # copies of one vector: a third of the rows
    s = cosines(rows, rows)
    want = defaultdict(int)
    for i, j in zip(*np.nonzero(s >= 0.92), strict=True):
        want[rows[i][0]] += i != j
    got = {r.id: r for r in SI.similar_links(spark.createDataFrame(rows, VECTORS).repartition(5), 0.92).collect()}
    assert len(got) == len(rows)
    total, found = sum(want.values()), sum(r.n_links for r in got.values())
    assert all(r.n_links <= want[i] for i, r in got.items()) and found >= 0.95 * total
    classes = defaultdict(list)
    for i, v in rows:
        classes[tuple(v)].append(i)
    assert all(got[i].class_id == min(ids) for ids in classes.values() for i in ids)


def test_pairs_come_once(spark):
    rng = np.random.default_rng(6)
    rows = made(rng, 50, 16, [(60, 0.05)])
    both = SI._side(spark.createDataFrame(rows, VECTORS), "target", "vec_id", "embedding")
    linked = SI.linked_classes(both.unionByName(both.withColumn("side", F.lit("corpus"))), 0.9)
    pairs = linked.pairs.collect()
    assert len({(p.a, p.b) for p in pairs}) == len(pairs) and all(p.a < p.b for p in pairs)
    assert len(pairs) >= 0.95 * 60 * 59 / 2


def test_many_targets_equal_the_exact_path(spark):
    rng = np.random.default_rng(8)
    corpus = made(rng, 400, 32, [(30, 0.1)] * 10)
    targets = [(10_000 + k, [float(x + e) for x, e in zip(v, rng.normal(size=32) * 0.02 * np.linalg.norm(v) / 6, strict=True)]) for k, v in corpus]
    c, t = spark.createDataFrame(corpus, VECTORS), spark.createDataFrame(targets, VECTORS)
    exact = VC.similar_docs(c, t, 5, exclude_self=False).where("score >= 0.9").collect()
    got = SI.similar_docs_many(c, t, 5, 0.9, exclude_self=False).collect()
    found = {(r.target_id, r.id): r.score for r in got}
    assert len(found) == len(got) and all(r.rank <= 5 for r in got)
    hit = sum(math.isclose(found.get((r.target_id, r.id), 0), r.score, rel_tol=1e-9) for r in exact)
    assert hit >= 0.95 * len(exact) > 400


def test_top_rows_of_copies_and_self(spark):
    """Ties rank by id; copies beyond the first k never meet the targets."""
    v, w = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, -2.0, 1.0]
    rows = [(k, v) for k in range(200)] + [(500, w), (501, [2 * x for x in w])]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = defaultdict(list)
    for r in sorted(SI.similar_docs_many(df, df, 3, 0.9).collect(), key=lambda r: (r.target_id, r.rank)):
        got[r.target_id].append(r.id)
        assert math.isclose(r.score, 1.0)
    assert got[0] == [1, 2, 3] and got[2] == [0, 1, 3] and got[150] == [0, 1, 2] and got[500] == [501] and got[501] == [500]


def test_vectors_without_direction_and_nothing(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, -1.0])]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.id: (r.class_id, r.n_links) for r in SI.similar_links(df, 0.9).collect()}
    assert got == {**{i: (i, 0) for i in (1, 2, 3, 4, 5, 6, 9)}, 7: (7, 1), 8: (8, 1)}
    assert SI.similar_links(df.limit(0), 0.9).collect() == [] and SI.similar_docs_many(df.limit(0), df, 3, 0.9).collect() == []
    assert len(SI.similar_links(df.where("vec_id < 4"), 0.9).collect()) == 3
