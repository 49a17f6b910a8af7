"""Dump/load contract and CSV round trip."""

import os
import uuid

import pytest

from pyspark.sql import functions as F

from sparkvox.operators.columns import columns_with_role
from sparkvox.operators.numbering import dense_numbers, join_by_position, numbers_in_groups
from sparkvox.session import bucketed, private_folder, scratch_path
from sparkvox.sources import corpus_io as IO


def parts_of(spark, docs):
    info = spark.createDataFrame([("lang", False, True, False, False)],
                                 "column_name string, is_date boolean, is_label boolean, is_train_data boolean, is_generated boolean")
    return {"docs": docs.select("doc_id", "text"), "aux_info": info, "aux_data": docs.select("doc_id", "lang"),
            "text_info": docs.groupBy().count()}


def test_dump_load_and_errors(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'a "quoted"\nline', "en"), (2, "b", "fr")], "doc_id long, text string, lang string")
    parts = parts_of(spark, docs)
    path = str(tmp_path / "dump")
    IO.corpus_dump(parts, path)
    loaded = IO.corpus_load(spark, path)
    back = loaded["docs"].join(loaded["aux_data"], "doc_id").select(*docs.columns)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in docs.collect())
    assert columns_with_role(loaded["aux_data"], "is_label") == ["lang"]
    assert loaded["meta"].count() == 1

    with pytest.raises(FileNotFoundError):
        IO.corpus_load(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        IO.corpus_dump({k: v for k, v in parts.items() if k != "docs"}, path)
    with pytest.raises(ValueError):
        IO.corpus_dump(parts | {"other": docs}, path)

    # a part that was not written to its end
    broken = str(tmp_path / "broken")
    IO.corpus_dump(parts | {"words": docs}, broken)
    (folder,) = [f for f in os.listdir(broken) if f.startswith("dump-")]
    os.remove(os.path.join(broken, folder, "words", "_SUCCESS"))
    with pytest.raises(FileNotFoundError):
        IO.corpus_load(spark, broken)

    # unsupported version
    old = str(tmp_path / "old")
    IO.corpus_dump(parts, old)
    IO.read_meta(spark, old).selectExpr("'0.2.0' AS version", "'9' AS saved_at", "folder", "parts", "number + 1 AS number").write.parquet(
        os.path.join(old, "meta", "later"))
    with pytest.raises(ValueError):
        IO.corpus_load(spark, old)


def test_dump_cut_short_leaves_the_one_before(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old", "en")], "doc_id long, text string, lang string")
    path = str(tmp_path / "dump")
    IO.corpus_dump(parts_of(spark, docs), path)
    new = parts_of(spark, docs.withColumn("text", F.lit("new")))
    new["text_info"] = new["text_info"].withColumn("x", F.raise_error(F.lit("stopped")))
    with pytest.raises(Exception, match="stopped"):
        IO.corpus_dump(new, path)
    assert IO.corpus_load(spark, path)["docs"].first().text == "old"
    IO.corpus_dump(parts_of(spark, docs.withColumn("text", F.lit("newer"))), path)
    assert IO.corpus_load(spark, path)["docs"].first().text == "newer"


def test_model_places_later_documents(spark, tmp_path):
    from sparkvox.operators import docmap

    df = spark.createDataFrame([(i, [1.0 * i, 1.0, -2.0 + i % 3]) for i in range(12)], "vec_id long, embedding array<double>")
    path = str(tmp_path / "model")
    model = docmap.fit_map(df.filter("vec_id < 9"))
    again = IO.persist_model(model, path)
    a, b = (sorted(tuple(r) for r in docmap.document_map_2d(df, model=m).collect()) for m in (model, again))
    assert a == b and len(a) == 12


def test_scratch_must_be_shared():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            private_folder(master)
    assert os.path.isdir(private_folder("local[4]"))


def test_csv_keeps_white_space(spark, tmp_path):
    texts = ["  lead and trail  ", "\ttab\n", " ", "", None, "a,b", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = str(tmp_path / "csv")
    IO.write_corpus_csv(df, path, file_rows=2)
    got = [r.text for r in IO.read_corpus_csv(spark, path, schema=df.schema).orderBy("doc_id").collect()]
    assert got == texts


def test_generated_ids(spark):
    rows = [("a", 1), ("b", 2), ("a", 2), ("a", 1), (None, 1), ("", None), ("1", 11), ("11", 1), ("a", 1)]
    df = spark.createDataFrame(rows, "t string, x int")
    ids = [sorted(((str(r.text), str(r.x)), r.doc_id) for r in IO.corpus_from_dataframe(d, "t").collect())
           for d in (df, df.repartition(3, "x"), df.coalesce(1))]
    assert ids[0] == ids[1] == ids[2]
    assert sorted(i for _, i in ids[0]) == list(range(len(rows)))  # dense, equal rows apart
    assert sorted(c for c, _ in ids[0]) == sorted((str(t), str(x)) for t, x in rows)
    assert IO.corpus_from_dataframe(df.limit(0), "t").collect() == []


def test_csv_round_trip_and_nested_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'say "hi",\nthen go', "en"), (2, "", "fr")], "doc_id long, text string, lang string")
    path = str(tmp_path / "csv")
    IO.write_corpus_csv(docs, path)
    back = IO.read_corpus_csv(spark, path, schema=docs.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'say "hi",\nthen go', "en"), (2, "", "fr")]
    dup = docs.toDF("doc_id", "text", "lang").select("doc_id", "text", "lang", "lang").toDF("doc_id", "text", "Lang", "lang")
    corpus = IO.corpus_from_dataframe(dup, "text", "doc_id")
    assert corpus.columns == ["doc_id", "text", "Lang_00", "lang_01"]
    assert corpus.count() == 2


def test_numbers_are_dense_and_spread(spark):
    """A third of all rows share a key, some have none."""
    rows = [(k, "hot" if k % 3 == 0 else None if k % 7 == 0 else f"w{k % 50:02d}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, w string").repartition(6)
    out = dense_numbers(df, ["w"])
    got = out.collect()
    assert sorted(r.row_no for r in got) == list(range(3000)) and sorted((r.id, r.w) for r in got if r.w) == sorted(r for r in rows if r[1])
    words = [r.w for r in sorted(got, key=lambda r: r.row_no)]
    assert words == sorted((w for _, w in rows), key=lambda w: (w is not None, w))
    assert max(out.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 1500
    falling = dense_numbers(df, [-F.col("id")], "n").collect()
    assert all(r.n == 2999 - r.id for r in falling)
    assert dense_numbers(df.limit(0), ["w"]).collect() == []
    with pytest.raises(ValueError):
        dense_numbers(df, ["w"], "ID")


def test_joins_by_position_need_partners(spark):
    left, right = (spark.createDataFrame([(k, f"{s}{k}") for k in range(n)], f"row_no long, {s} string") for s, n in (("l", 5), ("r", 4)))
    got = join_by_position(left.where("row_no < 4"), right).collect()
    assert sorted((r.row_no, r.l, r.r) for r in got) == [(k, f"l{k}", f"r{k}") for k in range(4)]
    for a, b in ((left, right), (left.where("row_no < 3"), right)):
        with pytest.raises(Exception, match="only one of the tables has a row_no"):
            join_by_position(a, b).collect()


def test_vectors_leave_and_come_back(spark):
    words = spark.createDataFrame(
        [(d, s, w, f"t{w}", f"l{w}", False, "NOUN", "dep", None, [float(d), float(s), float(w)]) for d in (3, 1) for s in range(2) for w in range(3)],
        "doc_id long, sent_id int, word_id int, text string, lemma string, is_stop boolean, pos string, dep string, ent_type string, vector array<double>")
    nested = IO.word_table_to_docs(words)
    flat, vectors = IO.split_vectors(IO.docs_to_word_table(nested))
    assert vectors.columns == ["word_no", "vector"] and "vector" not in flat.columns
    assert [r.vector for r in vectors.orderBy("word_no").collect()] == [[d, s, w] for d in (1., 3.) for s in (0., 1.) for w in (0., 1., 2.)]
    again = IO.word_table_to_docs(flat, vectors)
    key = lambda r: r.doc_id
    assert sorted(again.collect(), key=key) == sorted(nested.collect(), key=key)
    back = IO.docs_to_word_table(again).select(words.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, words.collect()), key=str)


def test_newest_dump_has_the_greatest_number(spark, tmp_path):
    """Many dumps within a second, and one of before dumps had numbers."""
    docs = spark.createDataFrame([(1, "0", "en")], "doc_id long, text string, lang string")
    path = str(tmp_path / "dump")
    IO.corpus_dump(parts_of(spark, docs), path)
    meta = os.path.join(path, "meta")
    (only,) = os.listdir(meta)
    old = spark.read.parquet(os.path.join(meta, only)).drop("number")
    old.withColumn("saved_at", F.lit("2999-01-01 00:00:00")).write.parquet(os.path.join(meta, "old"))
    for k in range(1, 5):
        IO.corpus_dump(parts_of(spark, docs.withColumn("text", F.lit(str(k)))), path)
        loaded = IO.corpus_load(spark, path)
        assert loaded["docs"].first().text == str(k) and loaded["meta"].first().number == k + 1


def test_words_are_numbered_where_they_are(spark, monkeypatch):
    """Groups of many sizes, one without a key, equal rows; the rows are not dealt anew by range."""
    rows = [(None if g == 3 else g * 7, k // 2, "x" * g) for g in range(40) for k in range(g)]
    df = spark.createDataFrame(rows, "g long, at int, t string").repartition(5, "g")
    got = numbers_in_groups(df, "g", ["at"], "no").orderBy("no").collect()
    assert [r.no for r in got] == list(range(len(rows)))
    assert [(r.g, r.at, r.t) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    with pytest.raises(ValueError):
        numbers_in_groups(df, "g", ["at"], "T")
    words = df.select(F.col("g").alias("doc_id"), F.lit(0).alias("sent_id"), F.col("at").alias("word_id"), F.array(F.lit(1.0)).alias("vector"))
    monkeypatch.setattr(IO, "dense_numbers", None)  # deals all rows by range
    flat, vectors = IO.split_vectors(words)
    assert flat.count() == vectors.select("word_no").distinct().count() == len(rows)


def words_in_buckets(spark, rows, n):
    df = spark.createDataFrame([(d, s, w, t, t.lower(), False, "NOUN", "dep", None, [float(len(t)), float(ord(t[0]))]) for d, s, w, t in rows],
                               "doc_id long, sent_id int, word_id int, text string, lemma string, is_stop boolean, pos string, dep string, ent_type string, vector array<double>")
    name = f"words_{uuid.uuid4().hex}"
    bucketed(df.repartition(n, "doc_id"), n, "doc_id", name, scratch_path(spark, name))
    return spark.table(name)


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


WORDS = [(d, s, w, f"{'abc'[w]}{d}") for d in (9, 2, 5, 40, 11) for s in range(3) for w in range(d % 3 + 1)]


def test_words_and_vectors_meet_where_they_lie(spark, no_broadcast):
    """Split and put together again, words in buckets by document are not shuffled; the nested documents are made once."""
    words = words_in_buckets(spark, WORDS, 3)
    flat, vectors = IO.split_vectors(IO.docs_to_word_table(IO.word_table_to_docs(words)), buckets=3)
    again = join_by_position(flat, vectors, "word_no")
    assert again.columns == [*flat.columns, "vector"]
    assert not [e for e in exchanges(again) if "doc_id" in e or "word_no" in e]
    got = again.orderBy("word_no").collect()
    assert [r.word_no for r in got] == list(range(len(WORDS)))
    assert [(r.doc_id, r.sent_id, r.word_id, r.text) for r in got] == sorted(WORDS)
    assert all(r.vector == [float(len(r.text)), float(ord(r.text[0]))] for r in got)
    for a, b in ((flat, vectors.where("word_no <> 4")), (flat.where("word_no <> 4"), vectors),
                 (flat, vectors.withColumn("doc_id", F.when(F.col("word_no") == 4, -1).otherwise(F.col("doc_id"))))):
        with pytest.raises(Exception, match="only one of the tables has a word_no"):
            join_by_position(a, b, "word_no").collect()


def test_words_of_documents_without_an_id_meet(spark):
    words = words_in_buckets(spark, [*WORDS, (None, 0, 0, "x"), (None, 0, 1, "yy")], 3)
    flat, vectors = IO.split_vectors(words, buckets=3)
    got = join_by_position(flat, vectors, "word_no").orderBy("word_no").collect()
    assert len(got) == len(WORDS) + 2 and [r.doc_id for r in got[:2]] == [None, None]
    assert all(r.vector == [float(len(r.text)), float(ord(r.text[0]))] for r in got)


def test_a_dump_keeps_its_buckets(spark, tmp_path, no_broadcast):
    """Words and vectors of a loaded dump become documents without a shuffle; no table is stored besides the dump's parts."""
    docs = spark.createDataFrame([(d, "t", "en") for d in (9, 2)], "doc_id long, text string, lang string")
    rows = [*WORDS, *WORDS[:5]]  # a word that comes twice keeps its vector
    words = words_in_buckets(spark, rows, 3)
    numbered, vectors = IO.split_vectors(words, buckets=3, follows="lemma")
    assert not [f for f in numbered.inputFiles() if "numbered-" in f]
    path = str(tmp_path / "it's a dump")
    IO.corpus_dump(parts_of(spark, docs) | {"words": numbered, "word_vectors": vectors}, path, {"words": 3, "word_vectors": 3})
    loaded = IO.corpus_load(spark, path)
    assert loaded["words"].agg(F.count_distinct("word_no"), F.max("word_no")).first()[:] == (len(rows), len(rows) - 1)
    nested = IO.word_table_to_docs(loaded["words"], loaded["word_vectors"])
    assert exchanges(nested) == []
    key = lambda r: r.doc_id
    assert sorted(nested.collect(), key=key) == sorted(IO.word_table_to_docs(words).collect(), key=key)
    assert IO.corpus_load(spark, path)["words"].count() == len(rows)  # loaded twice
