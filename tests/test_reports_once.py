"""Expressions of reports stand once in the plan: Spark evaluates one wherever it stands within lambda functions."""

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import scalar
from seriesmill.operators import reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("read", [reports.lab_lines, reports.lab_values, reports.dates, reports.document_date])
def test_text_is_split_once(spark, tmp_path, read):
    spark.createDataFrame([(1, "WBC: 5.0 g/dL\nTest date: 3 May 2024")], "k int, t string").write.parquet(str(tmp_path / "t"))
    df = read(spark.read.parquet(str(tmp_path / "t")), "k", "t")
    assert plan(df).count("regexp_replace(coalesce(t#") == 1
    assert df.count() == 1


def test_date_is_cut_once(spark):
    df = spark.createDataFrame([("3 May 2024",), ("2024-02-30",), ("05/13/24",), (None,)], "s string").select(scalar.parse_date_any(F.col("s")).cast("string").alias("d"))
    assert plan(df).count("split(") == 1
    assert [r["d"] for r in df.collect()] == ["2024-05-03", None, "2024-05-13", None]


def test_words_of_two_texts_are_cut_once(spark):
    rows = [("a b c d", "a x c"), ("a", "b"), ("", "a b"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string").select(F.round(scalar.word_error_accuracy(F.col("a"), F.col("b")), 6).alias("x"))
    assert plan(df).count("split(") == 2
    assert [r["x"] for r in df.collect()] == [0.5, 0.0, 0.0, 0.0, 0.0]
