"""mini_words, mini_vocab, mini_cooc, mini_tfidf (FIXTURES §3)."""

import math

import pytest
from pyspark.sql import functions as F

from sparkvox.operators import network as NW
from sparkvox.operators import wordstats as WS

WORD = "doc_id long, sent_id int, word_id int, text string, lemma string, is_stop boolean, pos string, dep string, ent_type string"


def w(doc, sent, i, lemma, pos="NOUN", stop=False, ent=None):
    return (doc, sent, i, lemma, lemma, stop, pos, "dep", ent)


def test_filter_predicate(spark):
    rows = [
        w(1, 0, 0, "ない", "AUX"),            # kept AUX lemma
        w(1, 0, 1, "です", "AUX"),            # always dropped
        w(1, 0, 2, "will", "AUX"),            # AUX dropped
        w(1, 0, 3, "the", "DET", True, "X"),  # stop word with entity: kept
        w(1, 0, 4, "can", "AUX", False, "X"), # non-stop AUX with entity: dropped (first branch wins)
        w(1, 0, 5, "cat", "NOUN"),
        w(1, 0, 6, "and", "CCONJ", True),
        w(1, 0, 7, "run", "VERB", True),      # stop word without entity: dropped
    ]
    kept = {r.lemma for r in WS.filter_relevant(spark.createDataFrame(rows, WORD)).collect()}
    assert kept == {"ない", "the", "cat"}


def test_pad_and_delimiter(spark):
    rows = [w(1, 0, 0, "a"), w(1, 1, 0, "the", "DET", True), w(1, 2, 0, "b"), w(2, 0, 0, "and", "CCONJ", True)]
    words = spark.createDataFrame(rows, WORD)
    padded = WS.pad_empty_sentences(words)
    got = sorted((r.doc_id, r.sent_id, r.word_id, r.lemma, r.is_stop) for r in padded.collect())
    assert got == [(1, 0, 0, "a", False), (1, 1, -1, "", True), (1, 2, 0, "b", False), (2, 0, -1, "", True)]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    merged = {r.doc_id: r.merged for r in WS.merge_by_delimiter(padded, docs).collect()}
    g = "\u001d"
    assert merged == {1: f"a{g}{g}b{g}", 2: g, 3: g}
    split = sorted((r.doc_id, r.token_id, r.lemma) for r in WS.split_merged(WS.merge_by_delimiter(padded, docs)).collect())
    assert split == [(1, 0, "a"), (1, 1, "b")]


def vocab_words(spark):
    # 50 documents; word "e" in exactly 1 = 0.02*N, "f" in 49 = 0.98*N, "g" in 50.
    rows = []
    for d in range(50):
        rows.append(w(d, 0, 0, "g"))
        if d < 1:
            rows.append(w(d, 0, 1, "e"))
        if d < 49:
            rows.append(w(d, 0, 2, "f"))
        if d < 10:
            rows += [w(d, 0, 3, "b"), w(d, 0, 4, "a")]
    return spark.createDataFrame(rows, WORD), spark.range(50).withColumnRenamed("id", "doc_id")


def test_doc_frequency_thresholds(spark):
    words, docs = vocab_words(spark)
    got = {r.lemma: r.df for r in WS.doc_frequency(words, docs, 0.02, 0.98).collect()}
    assert got == {"e": 1, "f": 49, "a": 10, "b": 10}          # bounds inclusive, g above max
    got = {r.lemma for r in WS.doc_frequency(words, docs, 2, 50).collect()}
    assert got == {"f", "g", "a", "b"}                         # int = absolute count
    got = {r.lemma for r in WS.doc_frequency(words, docs, 0, 1.0).collect()}
    assert got == {"e", "f", "g", "a", "b"}                    # explicit 0 is honoured
    top = [r.lemma for r in WS.frequent_words(WS.doc_frequency(words, docs, 0, 1.0, max_vocab_size=4), 3).orderBy("rank").collect()]
    assert top == ["g", "f", "a"]                              # ties alphabetical at the cap


def test_co_occurrence(spark):
    rows = [
        w(1, 0, 0, "x"), w(1, 0, 1, "y"), w(1, 0, 2, "x"),   # x repeated in a sentence counts once
        w(1, 1, 0, "x"), w(1, 1, 1, "y"),                      # same pair in a second sentence
        w(2, 0, 0, "y"), w(2, 0, 1, "z"),
        w(3, 0, 0, "q"),                                        # word outside the vocabulary pairs nothing
    ]
    words = spark.createDataFrame(rows, WORD)
    vocab = spark.createDataFrame([("x", 2), ("y", 2), ("z", 1)], "lemma string, df long")
    co = {(r.lemma1, r.lemma2): r.n for r in NW.co_occurrence(words, vocab).collect()}
    assert co == {("x", "y"): 2, ("y", "x"): 2, ("y", "z"): 1, ("z", "y"): 1}
    docs = spark.range(3).withColumnRenamed("id", "doc_id")
    edges = NW.co_occurrence_edges(NW.sentence_pairs(words, vocab), docs, n_edge=1, min_co_occurrence=1)
    e = edges.collect()
    assert [(r.lemma1, r.lemma2, r.weight, r.width) for r in e] == [("x", "y", 1.0, 12.0)]
    pv = spark.createDataFrame([("x", "VERB"), ("y", "NOUN")], "lemma string, pos string")
    nodes = {r.lemma: (r.size, r.color) for r in NW.co_occurrence_nodes(edges, vocab, pv).collect()}
    assert nodes == {"x": (1.0, "#4e79a7"), "y": (1.0, "#f28e2b")}


def test_empty_network_has_placeholder(spark):
    words = spark.createDataFrame([w(1, 0, 0, "x")], WORD)
    vocab = spark.createDataFrame([("x", 1)], "lemma string, df long")
    docs = spark.range(1).withColumnRenamed("id", "doc_id")
    edges = NW.co_occurrence_edges(NW.sentence_pairs(words, vocab), docs)
    assert edges.count() == 0
    nodes = NW.co_occurrence_nodes(edges, vocab, spark.createDataFrame([("x", "NOUN")], "lemma string, pos string"))
    r = nodes.collect()
    assert len(r) == 1 and r[0].color == "#ffffff00" and r[0].size is None


def test_tfidf_by_label(spark):
    # labels A: x x y ; B: x z ; C: (no vocabulary word)
    rows = [("A", *w(1, 0, 0, "x")), ("A", *w(1, 0, 1, "x")), ("A", *w(2, 0, 0, "y")),
            ("B", *w(3, 0, 0, "x")), ("B", *w(3, 0, 1, "z")), ("C", *w(4, 0, 0, "q"))]
    words = spark.createDataFrame(rows, "label string, " + WORD)
    vocab = spark.createDataFrame([("x",), ("y",), ("z",)], "lemma string")
    labels = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, None)], "doc_id long, label string")
    got = {(r.label, r.lemma): r.weight for r in WS.tfidf_by_label(words, vocab, labels).collect()}
    n = 3  # every label counts, also C, which holds no vocabulary word
    idf = {"x": math.log((1 + n) / (1 + 2)) + 1, "y": math.log((1 + n) / 2) + 1, "z": math.log((1 + n) / 2) + 1}
    a = {"x": 2 * idf["x"], "y": idf["y"]}
    b = {"x": idf["x"], "z": idf["z"]}
    for lab, vec in (("A", a), ("B", b)):
        norm = math.sqrt(sum(v * v for v in vec.values()))
        for k, v in vec.items():
            assert got[(lab, k)] == pytest.approx(v / norm)
    assert not any(k[0] == "C" for k in got)
    joined = WS.tfidf_by_label(words.drop("label"), vocab, labels).collect()
    assert {(r.label, r.lemma): pytest.approx(r.weight) for r in joined} == got


def test_long_sentence_blocks_give_every_pair_once(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for s in range(6):
        n = 40 if s == 0 else rnd.randint(2, 6)     # sentence 0 is "heavy"
        for i, lem in enumerate(rnd.sample([f"w{k}" for k in range(60)], n)):
            rows.append(w(1, s, i, lem))
    words = spark.createDataFrame(rows, WORD)
    vocab = spark.createDataFrame([(f"w{k}", 1) for k in range(60)], "lemma string, df long")
    plain = sorted(tuple(r) for r in NW.sentence_pairs(words, vocab, block=1000).collect())
    for block in (1, 7, 10, 39):
        assert sorted(tuple(r) for r in NW.sentence_pairs(words, vocab, block=block).collect()) == plain
    assert len(plain) > 780


def test_whole_vocabulary_by_default(spark):
    rows = [w(d, 0, i, f"w{i}") for d in range(2) for i in range(20_500)]
    docs = spark.createDataFrame([(0,), (1,), (2,)], "doc_id long")
    words = spark.createDataFrame(rows, WORD)
    assert WS.doc_frequency(words, docs, 1, 2).count() == 20_500
    wide = WS.doc_term_wide(words.filter("word_id < 30"), docs, WS.doc_frequency(words, docs, 1, 2), 5)
    assert wide.columns == ["doc_id", "w0", "w1", "w10", "w100", "w1000"] and wide.filter("w10 = 1").count() == 2


def test_pos_vote_tie_breaks_alphabetically(spark):
    rows = [w(1, 0, 0, "run", "VERB"), w(1, 0, 1, "run", "NOUN"), w(1, 0, 2, "go", "VERB"),
            w(1, 0, 3, "go", "VERB"), w(1, 0, 4, "go", "NOUN")]
    got = {r.lemma: r.pos for r in WS.word_pos_majority(spark.createDataFrame(rows, WORD)).collect()}
    assert got == {"run": "NOUN", "go": "VERB"}
