"""Rule tokeniser and compound merging (mini_compound)."""

from sparkvox.operators.tokens import merge_compounds, tokenize_docs

WORD = "doc_id long, sent_id int, word_id int, text string, lemma string, is_stop boolean, pos string, dep string, ent_type string"


def test_tokenizer_basics(spark):
    df = spark.createDataFrame([(1, "The cat sat. New York is big!\nOk", "en")], "doc_id long, text string, lang string")
    rows = tokenize_docs(df).orderBy("sent_id", "word_id").collect()
    assert [(r.sent_id, r.word_id, r.text) for r in rows] == [
        (0, 0, "The"), (0, 1, "cat"), (0, 2, "sat"),
        (1, 0, "New"), (1, 1, "York"), (1, 2, "is"), (1, 3, "big"), (2, 0, "Ok"),
    ]
    by = {(r.sent_id, r.word_id): r for r in rows}
    assert by[(0, 0)].is_stop and by[(0, 0)].pos == "DET"
    assert by[(1, 0)].dep == "compound" and by[(1, 1)].dep == "dep"
    assert by[(1, 1)].ent_type == "PROPER" and by[(1, 0)].ent_type is None  # first word is not an entity
    assert by[(1, 2)].pos == "AUX"


def _w(doc, sent, i, text, dep, pos="NOUN", ent=None):
    return (doc, sent, i, text, text.lower(), False, pos, dep, ent)


def mini_compound(spark):
    rows = [
        # chain A-B-C then D
        _w(1, 0, 0, "A", "compound"), _w(1, 0, 1, "B", "compound"), _w(1, 0, 2, "C", "dep", "PROPN", "PROPER"),
        _w(1, 0, 3, "D", "dep"),
        # chain at sentence end
        _w(1, 1, 0, "x", "dep"), _w(1, 1, 1, "Y", "compound", "VERB"),
        # two chains
        _w(2, 0, 0, "P", "compound"), _w(2, 0, 1, "Q", "dep"), _w(2, 0, 2, "R", "compound"), _w(2, 0, 3, "S", "dep"),
        # none
        _w(3, 0, 0, "m", "dep"), _w(3, 0, 1, "n", "dep"),
    ]
    return spark.createDataFrame(rows, WORD)


def test_merge_compounds_merged(spark):
    out = merge_compounds(mini_compound(spark), "merged").orderBy("doc_id", "sent_id", "word_id").collect()
    got = [(r.doc_id, r.sent_id, r.word_id, r.text, r.pos, r.ent_type, r.is_stop) for r in out]
    assert got == [
        (1, 0, 0, "A B C", "PROPN", "PROPER", False), (1, 0, 3, "D", "NOUN", None, False),
        (1, 1, 0, "x", "NOUN", None, False), (1, 1, 1, "Y", "VERB", None, False),
        (2, 0, 0, "P Q", "NOUN", None, False), (2, 0, 2, "R S", "NOUN", None, False),
        (3, 0, 0, "m", "NOUN", None, False), (3, 0, 1, "n", "NOUN", None, False),
    ]


def test_merge_compounds_overlapping(spark):
    out = merge_compounds(mini_compound(spark), "overlapping").filter("doc_id = 1 AND sent_id = 0")
    assert [r.text for r in out.orderBy("word_id").collect()] == ["A B C", "B C", "C", "D"]


def test_compound_span_is_not_stop(spark):
    rows = [(1, 0, 0, "The", "the", True, "DET", "compound", None), (1, 0, 1, "Big", "big", False, "ADJ", "dep", None)]
    out = merge_compounds(spark.createDataFrame(rows, WORD)).first()
    assert out.text == "The Big" and out.is_stop is False and out.pos == "ADJ"


def test_plugin_tokenizer_and_embedder(spark):
    import numpy as np
    import pandas as pd

    from sparkvox.operators.tokens import tokenize_with
    from sparkvox.operators.vectors import embed_docs

    docs = spark.createDataFrame([(1, "a bb ccc"), (2, "dd")], "doc_id long, text string")

    def tok(pdf):
        rows = [(int(r.doc_id), 0, i, t, t.lower(), False, "NOUN", "dep", None)
                for r in pdf.itertuples() for i, t in enumerate(r.text.split())]
        return pd.DataFrame(rows, columns=WORD.replace(" long", "").replace(" int", "").replace(" string", "")
                            .replace(" boolean", "").split(", "))

    words = tokenize_with(docs, tok, WORD)
    assert sorted((r.doc_id, r.word_id, r.text) for r in words.collect()) == [
        (1, 0, "a"), (1, 1, "bb"), (1, 2, "ccc"), (2, 0, "dd")]

    def make():
        def predict(texts):
            return np.array([[len(t), t.count("c")] for t in texts], dtype=np.float32)
        return predict

    got = {r.doc_id: r.embedding for r in embed_docs(docs, make, 2).collect()}
    assert got == {1: [8.0, 3.0], 2: [2.0, 0.0]}


def test_merge_compounds_averages_vectors(spark):
    rows = [(1, 0, 0, "New", "new", False, "ADJ", "compound", None, [1.0, 3.0]),
            (1, 0, 1, "York", "york", False, "PROPN", "dep", "PROPER", [3.0, 5.0]),
            (1, 0, 2, "now", "now", False, "ADV", "dep", None, [0.0, 1.0])]
    words = spark.createDataFrame(rows, WORD + ", vector array<double>")
    got = {r.word_id: (r.text, r.vector) for r in merge_compounds(words).collect()}
    assert got == {0: ("New York", [2.0, 4.0]), 2: ("now", [0.0, 1.0])}


def test_words_without_a_chain_are_not_grouped(spark):
    """Words alone go straight to the result, those without a text too; equal keys stay apart."""
    rows = [(1, 0, 0, "a", "a", True, "DET", "dep", None), (1, 0, 1, None, None, None, None, None, None),
            (1, 0, 2, "B", "b", False, "PROPN", "compound", None), (1, 0, 3, "C", "c", False, "NOUN", "dep", "PROPER"),
            (2, 0, 0, "x", "x", False, "NOUN", "dep", None), (2, 0, 0, "x", "x", False, "NOUN", "dep", None),
            (None, None, 0, "y", "y", False, "NOUN", "dep", None)]
    df = spark.createDataFrame(rows, WORD)
    for mode, more in (("merged", []), ("overlapping", [(1, 0, 3, "C", "c", False, "NOUN", "PROPER", 1)])):
        out = merge_compounds(df, mode)
        want = [(1, 0, 0, "a", "a", True, "DET", None, 1), (1, 0, 1, "", "", None, None, None, 1), (1, 0, 2, "B C", "b c", False, "NOUN", "PROPER", 2),
                *[(2, 0, 0, "x", "x", False, "NOUN", None, 1)] * 2, (None, None, 0, "y", "y", False, "NOUN", None, 1), *more]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_buckets_follow_the_text_not_the_file(spark, tmp_path):
    """Copies of a text take few bytes of a file but as many words."""
    from sparkvox.plans import catalog as C

    d = str(tmp_path)
    spark.range(12000).selectExpr("id AS doc_id", "repeat('some words again. ', 500) AS text", "'en' AS lang").coalesce(1).write.parquet(f"{d}/documents.parquet")
    assert C.n_buckets(spark, d) == max(spark.sparkContext.defaultParallelism, -(-12000 * 9000 // C.BUCKET_BYTES))
