"""Mixing, line dedup, chunk recipes, decision lists."""

import random
from collections import Counter

import brute
import duckdb
import pytest
from brute import MESSY
from pyspark.sql import functions as F

from sparkvox.llm import chunk_dedup, line_dedup, mixing, rules
from sparkvox.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


def clash(docs, *names):
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(f"own {k}"))
    return docs


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_dedup_lines", "op5_chunk_recipes", "op9_warc"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(found)


def test_sql_on_messy_rows(spark, messy):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", MESSY)
    mixed = mixing.mix_sources(messy)
    assert Counter(map(tuple, mixed.collect())) == Counter(con.execute(mixing.oracle_sql()).fetchall())
    lines = line_dedup.dedup_lines(messy, min_sites=2, min_chars=1).select("doc_id", "text", "n_lines", "n_removed")
    assert Counter(map(tuple, lines.collect())) == Counter(con.execute(line_dedup.oracle_sql(2, 1)).fetchall())


def test_mix_follows_weights(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("source"))
    got = {r.source: r.n for r in mixing.mix_sources(docs, {"hot": 1, "cold": 3}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(got["hot"] - 1500) < 150 and abs(got["cold"] - 4500) < 250
    only = mixing.mix_sources(docs, {"cold": 1}).select("source").distinct().collect()
    assert [r.source for r in only] == ["cold"]


def test_mix_counts_are_poisson(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("s").alias("source"))
    counts = [r.n for r in mixing.mix_sources(docs, total=40000 * 3.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    counts += [0] * (20000 - len(counts))
    mean = sum(counts) / len(counts)
    spread = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert abs(mean - 3) < 0.05 and abs(spread - 3) < 0.12


def test_mix_is_the_same_for_any_partitioning(spark, small):
    a, b = (Counter((r.doc_id, r.copy, r.mix_key) for r in mixing.mix_sources(d).collect())
            for d in (small, small.repartition(7, "n_chars")))
    assert a == b


def test_mix_large_rate(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert 800 < mixing.mix_sources(docs, total=1000.0).count() < 1200


def test_clashing_and_empty(spark, messy, none):
    mixed = mixing.mix_sources(clash(messy, "copy", "MIX_KEY", "_rate"))
    assert mixed.columns[-2:] == ["copy_", "mix_key_"] and mixed.first()["copy"] == "own 0"
    lines = line_dedup.dedup_lines(clash(messy, "n_lines", "_gone", "h"))
    assert "n_lines_" in lines.columns and lines.count() == len(MESSY)
    assert chunk_dedup.exact_duplicates(clash(messy, "kept", "rid", "recipe")).count() == len(MESSY)
    scored = rules.quality_rules(clash(messy, "kept", "n_words", "_text"), [])
    assert scored.count() == len(MESSY) and dict(scored.dtypes)["kept"] == "boolean"
    assert mixing.mix_sources(none).count() == line_dedup.dedup_lines(none).count() == 0
    assert chunk_dedup.exact_duplicates(none).count() == rules.quality_rules(none, []).count() == 0


def test_line_near_threshold_is_exact(spark):
    rows = [(i, f"a line that {t} sites carry\nown {i}", f"s{k}") for t in range(3, 60, 4) for k in range(t) for i in [t * 100 + k]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (7, 30, 31, 55):
        got = line_dedup.dedup_lines(docs, min_sites=least, min_chars=5)
        gone = Counter(r.doc_id // 100 for r in got.where("n_removed > 0").collect())
        assert gone == Counter({t: t - 1 for t in range(3, 60, 4) if t >= least})


def test_chunks_make_up_the_text(spark, messy):
    made = messy.select(F.regexp_extract_all(chunk_dedup.without_spaces(F.col("text")), F.lit(chunk_dedup.CHUNK), 0).alias("c"),
                        chunk_dedup.without_spaces(F.col("text")).alias("t"))
    for r in made.collect():
        assert "".join(r.c) == r.t and all(len(c) <= chunk_dedup.MAX_CHUNK for c in r.c)


def test_chunks_survive_an_edit(spark):
    rng = random.Random(9)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(60000))
    docs = spark.createDataFrame([(1, text), (2, "inserted" + text)], "doc_id long, text string")
    a, b = (set(r.c) for r in docs.select(F.regexp_extract_all("text", F.lit(chunk_dedup.CHUNK), 0).alias("c")).collect())
    assert len(a & b) > 0.8 * len(a)


def test_exact_duplicates(spark, messy):
    got = {}
    for weak in (F.xxhash64, lambda c: F.length(c).cast("long") * 0):  # the second puts all chunks at one address
        rows = chunk_dedup.exact_duplicates(messy, address=weak).collect()
        got[weak] = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows)
    assert len(set(map(str, (sorted(map(str, g.items())) for g in got.values())))) == 1
    kept = sorted(str(r.doc_id) for r in rows if r.kept)
    # 1 and null are equal (1 stays); 3, 4 and 5 hold no text, of which 5 is longest; one of the two 6 stays.
    assert kept == sorted(["1", "2", "5", "6", "7", "8", "9", "10"])
    left = chunk_dedup.without_exact_duplicates(messy)
    assert left.columns == messy.columns and left.count() == 8


def test_equal_but_for_spaces(spark):
    docs = spark.createDataFrame([(5, "a b c"), (4, "abc"), (3, "a\nb\x0bc\r"), (2, "a bc"), (1, "a b c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in chunk_dedup.exact_duplicates(docs).collect()}
    assert got == {5: (3, 4, False), 4: (3, 4, False), 3: (3, 4, True), 2: (2, 1, True), 1: (3, 4, False)}


def test_counts_of_texts(spark, messy, small):
    extra = spark.createDataFrame(
        [(20, " ".join(["a b c d e f g h"] * 3)), (21, "x y " * 30), (22, " ".join(map(str, range(50))) + " " + " ".join(map(str, range(10, 30)))),
         (23, "## a\n\n \na\n## a\na")], "doc_id long, text string")
    docs = messy.select("doc_id", "text").union(extra).union(small.select("doc_id", "text"))
    for r in rules.text_statistics(docs.withColumn("t", F.col("text"))).collect():
        assert tuple(r[c] for c in rules.BASE) == brute.text_counts(r.t)


def test_rules_are_learned_and_ordered():
    rows = [{f: 0.0 for f in rules.FEATURES} | {"words": float(i), "symbols_per_word": float(i % 5 == 0), "upper_share": i % 7 / 7,
            "bad": i % 5 == 0 or i % 7 == 6, "held": i % 3 == 0} for i in range(400)]
    found = rules.learned_list(rows)
    assert 2 <= len(found) <= 3
    assert all(any(rules.covers(r, x) for r in found) == x["bad"] for x in rows)
    assert rules.learned_list([]) == rules.learned_list([r | {"bad": False} for r in rows]) == []


def test_verdict_is_the_list(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = rules.learn_rules(small, labels, min_support=1)
    got = rules.quality_rules(small, found)
    wrong = got.where(F.col("kept") != (~F.col("base_failed") & F.col("rule").isNull())).count()
    assert found and wrong == 0
    rejected = {r.doc_id for r in got.where("rule is not null").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    hit = [known[d] for d in rejected if d in known]
    assert hit and sum(h == 0 for h in hit) / len(hit) >= 0.9


def test_labels_with_nulls(spark, messy):
    labels = spark.createDataFrame([(None, 0), (1, None), (2, 1), (2, 0), (99, 0)], "doc_id long, quality int")
    assert rules.learn_rules(messy, labels) == []
