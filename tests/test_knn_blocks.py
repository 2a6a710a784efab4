"""Exact nearest vectors by block products, and the ranking metrics by label, against the pairs spelled out."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesmill.functions import scalar
from seriesmill.operators import metrics, retrieval


def by_pairs(q, v, k):
    unit = lambda df, i, e: df.withColumn("norm", F.greatest(scalar.norm(F.col("embedding")), F.lit(1e-12))).select(F.col("vec_id").alias(i), F.transform("embedding", lambda x: x / F.col("norm")).alias(e))
    pairs = unit(v, "vec_id", "ve").join(unit(q, "query_id", "qe"), F.col("query_id") != F.col("vec_id"))
    scored = pairs.select("query_id", "vec_id", F.round(scalar.dot(F.col("qe"), F.col("ve")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], str(r["score"])) for r in df.collect())


def test_blocks_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 40)
    monkeypatch.setattr(retrieval, "TOGETHER", 15)
    monkeypatch.setattr(retrieval, "PRODUCT", 100)
    rng = np.random.default_rng(3)
    v = [(i, x.tolist()) for i, x in enumerate(rng.integers(-2, 3, (200, 3)).astype(float))]
    odd = [(900, None), (901, [1.0, None, 0.0]), (902, [float("nan"), 1.0, 1.0]), (903, [1.0, 2.0]), (904, [0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([*v, *((300 + i, [1.0, 1.0, 1.0]) for i in range(60)), *odd], "vec_id long, embedding array<double>").repartition(3)
    asked = df.filter("vec_id % 7 = 0 or vec_id >= 890")
    got = retrieval.knn(asked, df, 5)
    assert rows(got) == rows(by_pairs(asked, df, 5))
    # pairs aren't made of rows: only each block's best leave the product
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    assert rows(retrieval.knn(df, df, 9)) == rows(by_pairs(df, df, 9))
    assert retrieval.knn(df.filter("false"), df, 3).count() == 0


def test_ranking_by_label_is_ranking_by_pairs(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (2, 1), (3, None), (4, 2), (5, 9), (6, 2), (6, 2)], "id long, label int")
    queries = spark.createDataFrame([(0,), (2,), (3,), (5,), (6,)], "query_id long")
    results = spark.createDataFrame([(q, i, n + 1) for q in (0, 2, 3, 5, 6) for n, i in enumerate(x for x in (4, 1, 6, 2, 0, 5, 77) if x != q)], "query_id long, id long, rank int")
    gold = queries.join(labels.withColumnsRenamed({"id": "query_id", "label": "ql"}), "query_id").join(labels, (F.col("ql") == F.col("label")) & (F.col("query_id") != F.col("id"))).select("query_id", "id")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(metrics.ranking_by_label(results, queries, labels)) == told(metrics.ranking(results, gold))
