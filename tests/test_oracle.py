"""Every registered query with oracle SQL against DuckDB at sf0.001, and
partition independence of a shuffle-heavy query."""

import os

import pytest

import harness

SF = "/root/testdata/sf0.001"


def oracle_keys():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", oracle_keys())
def test_matches_duckdb(spark, con, name):
    r = harness.compare(spark, name, SF, con)
    assert r["cols_ok"] and r["values_ok"] and r["rows"] == r["duck_rows"], r


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_rows_only_queries_run(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_partition_independence(spark):
    from sparkvox.operators import network as NW
    from sparkvox.plans import catalog as C

    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            words = C.TK.tokenize_docs(C.clean_docs(spark, SF).repartition(3))
            padded = C.WS.pad_empty_sentences(words)
            vocab = C.WS.doc_frequency(padded, C.table(spark, SF, "documents"))
            res.append(sorted(tuple(r) for r in NW.sentence_pairs(padded, vocab).collect()))
        assert res[0] == res[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
