"""op7: tasks without rows, and those whose words were all handed on before their end."""

import pandas as pd
from pyspark.sql import functions as F

from seriesmill.llm import ppm


def test_tasks_without_rows_are_scored_like_others(spark):
    docs = spark.createDataFrame([(i, f"word {i} of a text") for i in range(40)], "doc_id long, text string")
    some = docs.filter("doc_id < 12")
    told = lambda df: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.score(df).collect())
    spread = docs.repartitionByRange(8, "doc_id").cache().filter(F.col("doc_id") < 12)
    assert 0 in spread.rdd.glom().map(len).collect()
    assert told(spread) == told(some.coalesce(1))


def test_a_task_hands_on_no_empty_counts():
    assert not list(ppm._count(iter([])))
    text = " ".join(map(str, range(400_001)))
    told = list(ppm._count(iter([pd.DataFrame({"text": [text]})])))
    assert all(len(x) for x in told) and sum(x["word"].notna().sum() for x in told) == 400_002
