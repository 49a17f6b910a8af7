"""Factorisation machine for quality."""

import itertools
import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkvox.llm import factorisation as fm
from sparkvox.llm import hashing, langid
from sparkvox.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"


def as_rows(found, n):
    out = [{} for _ in range(n)]
    for r, s, v in zip(*(x.tolist() for x in found), strict=True):
        out[r][s] = out[r].get(s, 0) + v
    return out


def test_pairs_are_weighed_without_listing_them():
    rng = np.random.default_rng(2)
    machine = fm.Machine(0.3, rng.normal(size=fm.SLOTS).astype(np.float32), rng.normal(size=(fm.SLOTS, 5)).astype(np.float32))
    rows = [{int(s): float(v) for s, v in zip(rng.choice(fm.SLOTS, k, False), rng.normal(size=k), strict=True)} for k in (0, 1, 2, 30)]
    found = [np.array([x for r, d in enumerate(rows) for x in [(r, *e)[k] for e in d.items()]]) for k in range(3)]
    got = machine.margins((found[0].astype(int), found[1].astype(int), found[2]), len(rows))
    for d, z in zip(rows, got, strict=True):
        want = 0.3 + sum(float(machine.weights[s]) * v for s, v in d.items()) + sum(
            float(machine.factors[a].astype(float) @ machine.factors[b].astype(float)) * d[a] * d[b] for a, b in itertools.combinations(d, 2))
        assert math.isclose(z, want, rel_tol=1e-6, abs_tol=1e-6)


def test_slots_of_a_text():
    texts = ["The cat, THE cat the end", "", None, "a|b 1!\n\na|b 1!", "é é é"]
    data, offsets = hashing.text_bytes(pa.array(texts))
    rows = as_rows(fm.text_slots(data, offsets), len(texts))
    each = 1 / math.sqrt(2 * fm.N_STATS)

    def stat(row, k):
        return row.get(fm._STATS_AT + k * (fm.BINS + 1) + fm.BINS, 0) / each

    for t, row in zip(texts, rows, strict=True):
        ws = brute.words(t, lower=True)
        words = sorted(v for s, v in row.items() if s < fm._STATS_AT)
        assert np.allclose(words, sorted(math.sqrt(c / len(ws)) for c in Counter(ws).values()))
        assert sum(s >= fm._STATS_AT for s in row) == 2 * fm.N_STATS
        pairs, size = list(itertools.pairwise(ws)), max(1, sum(b > 32 or b == 10 for b in (t or "").encode()))
        share = {0: sum("A" <= c <= "Z" for c in t or "") / size, 5: (t or "").count("!") / size, 6: (t or "").count("|") / size,
                 fm.N_STATS - 4: len(set(ws)) / max(len(ws), 1), fm.N_STATS - 1: sum(a == b for a, b in pairs) / max(len(ws), 1),
                 fm.N_STATS - 2: 1 - len(set(pairs)) / len(pairs) if pairs else 0}
        for k, x in share.items():
            assert math.isclose(stat(row, k), math.sqrt(x), abs_tol=1e-9), (t, k)


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "b", "B!", "|", "c1", "\n", "é"]) for _ in range(rng.randrange(400))) for _ in range(20)]
    data, offsets = hashing.text_bytes(pa.array(texts))
    whole = as_rows(fm.text_slots(data, offsets), len(texts))
    monkeypatch.setattr(hashing, "GROUP_BYTES", 100)
    monkeypatch.setattr(hashing, "SEGMENT", 30)
    parts = as_rows(fm.text_slots(data, offsets), len(texts))
    for a, b in zip(whole, parts, strict=True):
        assert a.keys() == b.keys() and all(math.isclose(a[s], b[s]) for s in a)


def test_learns_what_only_pairs_tell():
    """A label that is the exclusive or of two slots has no linear part."""
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 2))
    docs = [(None, np.array([fm._STATS_AT + a, fm._STATS_AT + 2 + b]), np.ones(2)) for a, b in bits.tolist()]
    y = (bits[:, 0] ^ bits[:, 1]).astype(float)
    machine = fm.fitted(docs, y)
    found = (np.repeat(np.arange(4000), 2), np.concatenate([d[1] for d in docs]), np.ones(8000))
    assert ((fm._sigmoid(machine.margins(found, 4000)) >= 0.5) == y).all()
    again = fm.fitted(docs, y)
    assert again.bias == machine.bias and (again.weights == machine.weights).all() and (again.factors == machine.factors).all()


def test_query_on_held_out_rows(spark):
    got = QUERIES["op11_factorisation"](spark, MIDDLE)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{MIDDLE}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [(rows[i]["score"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert sum((s >= 0.5) == q for s, q in held) >= 0.98 * len(held)
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.99 * len(good) * len(bad)


def labelled(spark, n=300):
    docs = [(i, "WORDS!! UP!! HERE!!" if i % 3 == 0 else f"plain words stand here {i}", i % 40) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), \
        spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)], "doc_id long, quality int")


def test_labels_and_lang_decide_nothing(spark):
    """Scores depend on text and metadata alone, and not on the labels of rows held out."""
    docs, labels = labelled(spark)
    held = langid.held_out(modulus=3, residue=1)
    one = fm.learn(docs, labels, chosen=~held)
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    two = fm.learn(docs.repartition(7), turned.repartition(5), chosen=~held)
    assert one.bias == two.bias and (one.weights == two.weights).all()
    a, b = (sorted(map(tuple, fm.score(d, one, keep=["text"]).collect())) for d in (docs, docs.withColumn("doc_id", -F.col("doc_id"))))
    assert a == b


def test_machine_is_kept(spark, tmp_path):
    docs, labels = labelled(spark)
    machine = fm.learn(docs, labels, metadata=("n_chars",))
    machine.save(spark, f"{tmp_path}/m")
    again = fm.Machine.load(spark, f"{tmp_path}/m")
    assert again.bias == machine.bias and (again.weights == machine.weights).all() and (again.factors == machine.factors).all()


def test_bounds_of_the_fit(spark, monkeypatch):
    docs, labels = labelled(spark)
    seen = []
    monkeypatch.setattr(fm, "fitted", lambda documents, y, **how: seen.append((len(documents), sum(len(d[1]) for d in documents))))
    fm.learn(docs, labels)
    fm.learn(docs, labels, max_labelled=100)
    fm.learn(docs, labels, max_slots=5000)
    hot = docs.unionByName(docs.where("doc_id = 3").crossJoin(spark.range(500)).drop("id"))  # equal rows count once
    fm.learn(hot, labels)
    assert seen[0][0] == seen[3][0] == 300 and 40 <= seen[1][0] <= 100 and 0 < seen[2][0] < 300 and seen[2][1] <= 5000


@pytest.mark.parametrize("metadata", [(), ("n_chars", "lang")])
def test_messy(spark, messy, none, metadata):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (6, 0), (6, 1), (None, 1), (8, None), (9, 7), (99, 1)], "doc_id long, quality int")
    machine = fm.learn(messy, labels, metadata=metadata)
    got = fm.score(messy, machine, metadata=metadata)
    assert got.columns == [*messy.columns, "score", "predicted"]
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in brute.MESSY)
    assert all(0 <= r["score"] <= 1 for r in rows)
    if not metadata:
        score = {r["doc_id"]: r["score"] for r in rows}
        assert score[3] == score[4] and score[1] == score[None]  # null as empty; equal texts alike
    clash = fm.score(messy.withColumn("Score", F.lit("own")).withColumn("_bins", F.lit(1)), machine, metadata=metadata)
    assert clash.columns[-4:] == ["Score", "_bins", "score_", "predicted"]
    assert sorted(r["score_"] for r in clash.collect()) == sorted(r["score"] for r in rows)
    assert fm.score(none, machine, metadata=metadata).collect() == []
    for docs, marks in ((none, labels), (messy, labels.limit(0)), (messy, labels.where("quality = 1"))):  # no two classes
        flat = {r["score"] for r in fm.score(messy, fm.learn(docs, marks)).collect()}
        assert len(flat) == 1 and 0 < flat.pop() < 1
