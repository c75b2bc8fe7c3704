"""Columns with dots in their names, maps within columns, and rows without an id."""

from pyspark.sql import functions as F

from quarryline.llm import exactdedup, mixing, toxicity


def test_any_column_names(spark):
    rows = [(1, "a b c", "s", 1, [{"k": 1}]), (1, "a b c", "s", 2, [{"k": 2}]), (1, "A B C", "s", 2, None), (None, "x y", None, 3, None), (2, None, "t", 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` int, maps array<map<string,int>>").repartition(2)
    kept = exactdedup.deduplicated(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]
    got = mixing.mixed(df)
    assert got.columns == df.columns and got.count() >= 3


def test_held_out_of_rows_without_an_id(spark):
    df = spark.createDataFrame([(None,), (1,), (4,)], "doc_id long")
    assert {r[0] for r in df.select(toxicity.held_out(F.col("doc_id"))).collect()} <= {True, False}
