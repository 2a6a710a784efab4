"""Fusion by rank counts what is ahead of the rows that can be best; scores by terms are summed where the document is."""

import math
import random

import pytest

from seriesmill.operators import retrieval
from seriesmill.operators.relational import topk_positive


def _scored(spark, kind):
    dice = random.Random(5)
    rows = [(q, f"d{i}" if kind == "string" else i, *(None if dice.random() < 0.2 else float(dice.randrange(40)) if q else dice.random() for _ in "ab")) for q in range(3) for i in range(600)]
    rows += [(7, rows[0][1], 1.0, None), (None, rows[0][1], 1.0, 2.0), (0, None, 39.0, 3.0), *((8, rows[i][1], None, None) for i in range(300))]
    return spark.createDataFrame(rows, f"query_id long, doc_id {kind}, a double, b double").repartition(5)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_the_best_by_rank_are_those_of_all_rows(spark, kind):
    scored = _scored(spark, kind).cache()
    best = lambda df: {tuple(r) for r in topk_positive(df, "query_id", 4, "score", "doc_id").collect()}
    every, some = retrieval.fuse_rank_columns(scored, ["a", "b"]), retrieval.fuse_rank_columns(scored, ["a", "b"], most=4)
    assert best(some) == best(every)
    assert some.count() < every.count()
    told = {tuple(r) for r in some.collect()}
    assert told <= {tuple(r) for r in every.collect()}


def test_many_queries_are_ranked_whole(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 2)
    scored = _scored(spark, "long")
    assert retrieval.fuse_rank_columns(scored, ["a", "b"], most=4).count() == scored.count()


def test_terms_are_summed_with_their_document(spark):
    asked = spark.createDataFrame([(1, "red fox red"), (2, "blue sky"), (3, "of the"), (4, None)], "query_id long, text string")
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue"), (2, "blue"), (3, None), (4, ""), (5, "sky red sky")], "doc_id long, text string")
    df = retrieval.term_scores(asked, docs, {"lexical": "bm25", "coverage": "coverage"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and "hashpartitioning(query_id#" not in plan.split("BroadcastExchange")[0]
    got = {(r["query_id"], r["doc_id"]): (r["lexical"], r["coverage"]) for r in df.collect()}
    assert {x: c for x, (_, c) in got.items()} == {(1, 1): 1.0, (1, 5): 0.5, (2, 2): 0.5, (2, 5): 0.5}
    # six documents, lengths 2, 1, 1, 0, 3 and none; the two of one id and length are one with the term twice
    idf = lambda n: math.log(1 + (6 - n + 0.5) / (n + 0.5))
    assert got[2, 2][0] == round(idf(1) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 1 / 1.4)), 6)
