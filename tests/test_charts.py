"""mini_clusters and mini_layout."""

import pytest
from pyspark.sql import functions as F

from sparkvox.operators import charts as CH


def test_positions_and_names(spark):
    pts = spark.createDataFrame(
        [(1, 0.0, 0.0, 0), (2, 2.0, 2.0, 0), (3, 4.0, 0.0, 1)], "doc_id long, x double, y double, label int"
    )
    got = {r.label: (r.x, r.y, r.size) for r in CH.cluster_positions(pts).collect()}
    assert got[0] == (0.0, pytest.approx(1.0), 1.0) and got[1] == (1.0, 0.0, 0.5)
    one = CH.cluster_positions(pts.filter("label = 0")).first()
    assert one.x is None and one.size == 1.0  # one label: 0/0 → NULL
    labels = spark.createDataFrame([(0,), (1,), (2,), (3,)], "label int")
    names = spark.createDataFrame([(0, "a"), (1, ""), (2, "2")], "label int, name string")
    disp = {r.label: r.display_name for r in CH.group_display_names(labels, names).collect()}
    assert disp == {0: "0:a", 1: "1:", 2: "2:", 3: "3:"}
    plain = {r.label: r.display_name for r in CH.group_display_names(labels, None).collect()}
    assert plain[3] == "3"
    cols = {r.label: r.color for r in CH.label_colors(labels).collect()}
    assert cols[0] == "#1f77b4" and cols[3] == "#d62728"
    many = spark.range(100, 125).selectExpr("CAST(id AS INT) AS label")
    cols = {r.label: r.color for r in CH.label_colors(many).collect()}
    assert None not in cols.values() and cols[100] == cols[120] == "#1f77b4" and len(set(cols.values())) == 20


def test_parse_layout_lines(spark):
    lines = spark.createDataFrame(
        [
            ('<text transform="translate(10,20) rotate(-90)" font-size="33" style="fill:rgb(255, 0, 16)">word</text>', 1),
            ('<text transform="translate(5,6)" font-size="7" style="fill:rgb(1, 2, 3)">two words</text>', 1),
            ('<svg width="900">', 1),
            ('<text style="fill:rgb(9, 8, 7)" font-size="12" transform="translate(1,2)">moved</text>', 1),
        ],
        "value string, label int",
    )
    got = [tuple(r) for r in CH.parse_layout_lines(lines).orderBy("x").collect()]
    assert got == [(1, 1, 2, 12, 9, 8, 7, "moved", 0, "#090807"), (1, 5, 6, 7, 1, 2, 3, "two words", 0, "#010203"), (1, 10, 20, 33, 255, 0, 16, "word", -90, "#ff0010")]


def test_selection_placeholders(spark):
    rows = spark.createDataFrame([(1, 0, "0:a", "t1")], "doc_id long, label int, display_name string, text string")
    sel = spark.createDataFrame([], "position long, doc_id long")
    got = CH.select_by_index(rows, sel).collect()
    assert len(got) == 3 and all(r.label == "-" and r.text.startswith("点を") for r in got)
    got = CH.select_by_label(rows, 0).collect()
    assert [(r.label, r.display_name, r.text) for r in got] == [("0", "0:a", "t1")]
    assert CH.document_table(rows, show_empty=True).count() == 3


def test_shared_tables_follow_the_files(spark, tmp_path):
    """A corpus whose files change is read anew within one application."""
    from sparkvox.plans import catalog

    d = str(tmp_path)
    row = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "Cats sleep.", "en", "a", 11)], row).coalesce(1).write.parquet(f"{d}/documents.parquet")
    assert sorted(r.lemma for r in catalog.words(spark, d).collect()) == ["cats", "sleep"]
    first = catalog.words(spark, d)
    assert first.inputFiles() == catalog.words(spark, d).inputFiles()
    spark.createDataFrame([(2, "Dogs run.", "en", "a", 9)], row).coalesce(1).write.mode("append").parquet(f"{d}/documents.parquet")
    assert sorted(r.lemma for r in catalog.words(spark, d).collect()) == ["cats", "dogs", "run", "sleep"]
    catalog.release(spark, d)
    assert catalog.words(spark, d).count() == 4
