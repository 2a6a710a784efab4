"""Retrieval with plugged scorers, answers, risk rules and models on small cases worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.functions import scalar
from seriesmill.operators import answers, cohort, evaluation, models, retrieval

DOCS = "doc_id long, text string, source string"


def docs(spark):
    return spark.createDataFrame([
        (1, "Iron carries oxygen in the blood. Short. Low iron is a dangerous thing to leave alone.", "handbook"),
        (2, "Iron tablets are taken with water, not with tea.", "leaflet"),
        (3, "Nothing of the kind is written in this text here.", "handbook"),
        (4, None, "handbook"), (5, "", None),
    ], DOCS)


def test_answers_cite_each_source_once_and_flagged_questions_are_not_looked_up(spark):
    asked = spark.createDataFrame([(1, "iron iron blood"), (2, "chest pain, iron"), (3, "zebra"), (4, None)], "query_id long, text string")
    got = {r["query_id"]: r for r in answers.answer_table(asked, docs(spark), [(1, "urgent", "chest pain")], {"urgent": "Call now."}).collect()}
    assert got[2]["flagged"] and got[2]["answer"] == "Call now." and got[2]["citations"] == []
    assert not got[3]["flagged"] and got[3]["answer"].startswith("Too little") and got[3]["citations"] == []
    assert got[4]["answer"] == got[3]["answer"]
    said = "Iron carries oxygen in the blood. Low iron is a worth discussing thing to leave alone. [1]\n\nIron tablets are taken with water, not with tea. [2]"
    assert got[1]["answer"] == said + "\n\nSources cited:\n[1] handbook\n[2] leaflet"
    assert [(c["index"], c["source"]) for c in got[1]["citations"]] == [(1, "handbook"), (2, "leaflet")]
    assert answers.answer_table(asked.filter("false"), docs(spark), [(1, "urgent", "x")], {}).count() == 0


def test_retrieve_gates_after_fusing(spark):
    asked = spark.createDataFrame([(1, "iron blood")], "query_id long, text string")
    scorers = {"lexical": retrieval.bm25, "coverage": answers.term_coverage}
    every = answers.retrieve(asked, docs(spark), scorers, {"lexical": 0.5, "coverage": 0.5, "unused": 0.0}, 5).collect()
    assert [(r["doc_id"], r["rank"]) for r in every] == [(1, 1), (2, 2)] and every[0]["score"] == 1.0
    gated = answers.retrieve(asked, docs(spark), scorers, {"lexical": 0.5, "coverage": 0.5}, 5, docs(spark).filter("doc_id <> 1")).collect()
    assert [(r["doc_id"], r["score"]) for r in gated] == [(2, every[1]["score"])]
    ranked = answers.retrieve(asked, docs(spark), scorers, {"lexical": 1.0, "coverage": 1.0}, 5, by_rank=True).collect()
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(1, round(2 / 61, 8)), (2, round(2 / 62, 8))]


def test_rank_fusion_puts_missing_ids_after_all(spark):
    scored = spark.createDataFrame([(1, 1, 3.0, None), (1, 2, 2.0, 5.0), (1, 3, None, None)], "query_id long, doc_id long, a double, b double")
    got = {r["doc_id"]: r["score"] for r in retrieval.fuse_rank_columns(scored, ["a", "b"]).collect()}
    assert got == {1: round(1 / 61 + 1 / 64, 8), 2: round(1 / 62 + 1 / 61, 8), 3: round(2 / 64, 8)}


def test_presets_sum_to_one():
    assert all(sum(retrieval.preset(p).values()) == pytest.approx(1.0) for p in retrieval.PRESETS)
    assert retrieval.preset("bm25") == {"lexical": 1.0}


def test_scoped_statistics_are_those_of_the_scope(spark):
    both = spark.createDataFrame([(1, "a", "iron blood"), (2, "a", "tea water"), (3, "b", "iron tea")], "doc_id long, s string, text string")
    asked = spark.createDataFrame([(1, "a", "iron")], "query_id long, s string, text string")
    got = retrieval.bm25(asked, both, scope=["s"]).collect()
    alone = retrieval.bm25(asked, both.filter("s = 'a'")).collect()
    assert [r["doc_id"] for r in got] == [1] and got == alone


def test_risk_rules_and_score_by_hand(spark):
    rows = spark.createDataFrame([(1, 6.0, 130.0, 11.5, 0.0, 59.0, None), (2, 5.0, 130.0, 12.5, 0.25, None, 0.2), (3, None, None, None, None, None, None)],
                                 "k long, hba1c double, fasting_glucose double, hemoglobin double, sex_female double, egfr double, tsh double")
    got = {(r["k"], r["condition"]): r["probability"] for r in cohort.rule_risk(rows, "k").collect()}
    order = ("type2_diabetes", "anemia", "ckd", "liver_dysfunction", "thyroid_dysfunction")
    assert [got[1, c] for c in order] == [0.55, 0.5, 0.8, 0.15, 0.15]
    assert [got[2, c] for c in order] == [0.75, 0.5, 0.15, 0.15, 0.7]
    assert all(got[3, c] == 0.15 for c in order)
    score = {r["k"]: r["score"] for r in cohort.heuristic_score(rows, "k").collect()}
    assert score[1] == pytest.approx(88 - 3 - 4.5 - 10.85 - 1.5)
    assert score[2] == pytest.approx(88 - 4.5 - 3.45) and score[3] == 88.0


def test_rerank_mixes_only_longitudinal_rows_and_keeps_zeros(spark):
    found = spark.createDataFrame([(1, 0.8, True), (2, 0.0, True), (3, 0.8, False), (4, 0.4, True)], "evidence_id long, score double, long boolean")
    roles = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "evidence_id long, role_score double")
    got = {r["evidence_id"]: r["score"] for r in retrieval.rerank(found, roles, F.col("long")).collect()}
    assert got == {1: 0.85, 2: 0.0, 3: 0.8, 4: 0.425}


def test_models_learn_what_is_there(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [(i, float(x) if i % 20 else None, float(y), float(y > 0), float(3 * y + 1)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double")
    p = {r["k"]: r["probability"] for r in models.RiskModels(["a", "b"], ["c"]).fit(df).transform(df, ["k"]).collect()}
    assert np.mean([(p[r[0]] > 0.5) == (r[3] > 0) for r in rows]) > 0.95
    m = models.ScoreModel(["a", "b"], "y").fit(df)
    said = {r["k"]: r["prediction"] for r in m.transform(df, ["k"]).collect()}
    assert np.corrcoef([said[r[0]] for r in rows], [r[4] for r in rows])[0, 1] > 0.99
    assert [r["feature"] for r in m.importance_table(1).collect()] == ["b"]


def vectors(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 0.05, (39, 4)) + [1, 0, 0, 0], [[-1, 2, -3, 1]]])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_outlier_factor_equals_brute_force(spark):
    x, df = vectors(spark)
    k, u = 5, x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 6)
    near = [sorted((j for j in range(len(x)) if j != i), key=lambda j: (-sim[i, j], j))[:k] for i in range(len(x))]  # noqa: B023
    d = np.maximum(1 - sim, 1e-9)
    kd = [max(d[i, j] for j in near[i]) for i in range(len(x))]
    density = np.array([1 / np.mean([max(d[i, j], kd[j]) for j in near[i]]) for i in range(len(x))])
    want = [np.mean(density[near[i]]) / density[i] for i in range(len(x))]
    got = {r["vec_id"]: r["lof"] for r in models.local_outlier_factor(df, k).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, rel=1e-3, abs=1e-3)
    assert max(got, key=got.get) == 39


def test_isolation_scores_the_odd_row_highest_and_agree_on_reruns(spark):
    _, df = vectors(spark)
    runs = [{r["vec_id"]: r["score"] for r in models.isolation_forest(d, "vec_id", "embedding").collect()} for d in (df, df.repartition(3))]
    assert runs[0] == runs[1] and max(runs[0], key=runs[0].get) == 39


def test_definition_is_the_first_sentence_of_the_least_document(spark):
    asked = spark.createDataFrame([(1, "What is the iron?"), (2, "what are zebras"), (3, "Why?"), (4, None)], "query_id long, text string")
    texts = spark.createDataFrame([(2, "Iron is a metal. Tea is hot."), (1, "Well. Iron is needed. Iron is old."), (3, None), (4, "")], "doc_id long, text string")
    got = evaluation.definition_lookup(asked, texts).collect()
    assert [(r["query_id"], r["sentence"]) for r in got] == [(1, "Iron is needed.")]


def test_word_errors_of_many_different_words(spark):
    a = " ".join(f"w{i}" for i in range(40_000, 40_300))
    got = spark.range(1).select(scalar.word_error_accuracy(F.lit(a), F.lit(a + " x y z"))).first()[0]
    assert got == pytest.approx(0.99)
