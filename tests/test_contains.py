"""Names in questions: every form of the join against brute force, and no broadcast of texts."""

import re

from seriesmill.operators.retrieval import contains_join


def test_contains_join(spark, tmp_path):
    texts = [(1, "The thing of the day"), (1, "und so weiter, of them"), (2, "nothing"), (None, "The OF THE"), (3, None), (4, "hba1c: the hba1c is high")]
    names = [("the",), ("of the",), ("thing",), ("und",), ("HbA1c is",), (None,), ("day",)]
    spark.createDataFrame(texts, "query_id int, text string").write.parquet(str(tmp_path / "q"))
    q, n = spark.read.parquet(str(tmp_path / "q")), spark.createDataFrame(names, "name string")
    holds = lambda t, x: t and x and re.search("[a-z0-9]+", x.lower()).group() in re.findall("[a-z0-9]+", t.lower()) and x.lower() in t.lower()
    want = {(i, x) for i, t in texts for (x,) in names if holds(t, x)}
    few, many = contains_join(q, n), contains_join(q, n, most_names=2)
    for df in (few, many):
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
