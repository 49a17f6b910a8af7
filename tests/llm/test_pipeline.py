"""The stages of the corpus pipeline, each against a plain version on its own input."""

from collections import Counter

import brute
import corpus_pipeline
import duckdb
import pytest
from brute import DOCS
from test_files import check_packing

from sparkvox.llm import line_dedup, mixing
from sparkvox.llm.common import written

SMALL = "/root/testdata/sf0.001"


def view(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in rows])
    return con


def plain(name, rows):
    """What a stage keeps of ``rows``, as a multiset of rows."""
    if name == "line deduplication":
        found = view(rows).execute(line_dedup.oracle_sql()).fetchall()
        new = {}
        for i, text, _, removed in found:
            new.setdefault(i, []).append((text, removed))
        out = Counter()
        for r in rows:
            text, removed = new[r.doc_id][0] if len(set(new[r.doc_id])) == 1 else next(
                x for x in new[r.doc_id] if x[1] == 0 and x[0] == r.text)
            if not removed or brute.words(text):
                out[(r.doc_id, text, r.lang, r.source, len(text) if removed else r.n_chars)] += 1
        return out
    if name == "near-duplicate removal":
        known = {id(r): k for k, r in enumerate(rows)}
        order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, known[id(r)]))
        of = brute.near_components([(k, r.text) for k, r in enumerate(order)])
        return Counter(tuple(r) for k, r in enumerate(order) if of[k][1] == k)
    assert name == "source mixing"
    found = view(rows).execute(mixing.oracle_sql()).fetchall()
    return Counter(tuple(r[:5]) for r in found)


@pytest.mark.parametrize("table", ["small", "messy"])
def test_stages(spark, request, table):
    docs = request.getfixturevalue(table)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SMALL), "test_stage")
        after = docs.collect()
        if name == "language identification":
            left = Counter((r.doc_id, r.text) for r in after)
            gone = Counter((r.doc_id, r.text) for r in before) - left
            assert left <= Counter((r.doc_id, r.text) for r in before) and None not in {r.lang for r in after}
            # What has letters and is not one or two words stays.
            assert all(len(brute.words(t)) <= 2 or not any(c.isalpha() for c in t) for _, t in gone)
        elif name == "packing":
            # Copies of a document are equal pieces.
            check_packing(after, [(r.doc_id, r.text) for r in before], 4096)
        else:
            assert Counter(tuple(r) for r in after) == plain(name, before), name
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_and_empty(spark, none):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_boilerplate_alone_goes(spark):
    line = "all rights reserved by everyone"
    rows = [(k, line if k else line + "\nfirst", "en", f"s{k}", 31) for k in range(6)] + [(9, "", "en", "s1", 0), (10, " own text\n" + line, "en", "s2", 5)]

    left = corpus_pipeline.remove_boilerplate(spark, spark.createDataFrame(rows, DOCS), "")
    assert {(r.doc_id, r.text, r.n_chars) for r in left.collect()} == {(0, line + "\nfirst", 31), (9, "", 0), (10, " own text", 9)}
