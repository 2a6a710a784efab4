"""One retrieval reads the texts once for all scores by terms."""

from pyspark.sql import functions as F

from seriesmill.operators import answers, retrieval


def test_texts_are_read_once_for_both_scores(spark, monkeypatch):
    reads, real = [], retrieval.term_scores
    monkeypatch.setattr(retrieval, "term_scores", lambda *a, **b: reads.append(1) or real(*a, **b))
    asked = spark.createDataFrame([(1, "red fox"), (2, "blue sky")], "query_id long, text string")
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, "sky red")], "doc_id long, text string")
    scorers = {"lexical": retrieval.bm25, "coverage": answers.term_coverage}
    df = answers.retrieve(asked, docs, scorers, {"lexical": 0.5, "coverage": 0.5}, 2)
    assert len(reads) == 1
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in df.orderBy("query_id", "rank").collect()][0] == (1, 1, 1)
    mixed = scorers | {"one": lambda q, d: q.select("query_id").crossJoin(d.select("doc_id")).withColumn("score", F.lit(1.0))}
    assert answers.retrieve(asked, docs, mixed, {"lexical": 0.5, "coverage": 0.2, "one": 0.3}, 5).count() == 6
