"""Evidence where pairs stay with their patient: no shuffle or table of pairs, and a patient with many questions is dealt to several tasks."""

import datetime

from pyspark.sql import functions as F

from seriesmill.operators import hybrid, retrieval, selection

FULL = retrieval.preset("full")


def tables(spark):
    day = lambda n: datetime.datetime(2024, 1 + n % 9, 1 + n % 27)
    obs = [(p, ["Glucose", "Sodium", "Iron"][n % 3], day(n * 7 + p), float(n * 37 % 300), p * 100 + n) for p in (1, 2, 3) for n in range(20)]
    asked = [(p * 100 + n, p, ["glucose", "iron", None][n % 3], ["glucose 2024", "show the first abnormal sodium", None, "iron iron 03 glucose"][n % 4], ["CURRENT_VALUE", "ABNORMALITY", "LONGITUDINAL_TREND"][n % 3], None, None, None, None, None, None)
             for p in (1, 2, 4) for n in range(12)]
    return spark.createDataFrame(asked, selection.QUESTION), spark.createDataFrame(obs, "patient_id long, analyte string, ts timestamp_ntz, value double, evidence_id long")


def test_shares_change_nothing(spark, monkeypatch):
    for by_rank in (False, True):
        run = lambda: sorted(map(tuple, hybrid.retrieve_evidence(*tables(spark), FULL, 6, F.col("value") > 200, by_rank=by_rank).collect()))  # noqa: B023, E731
        monkeypatch.setattr(hybrid, "PAIRS", 1 << 20)
        whole = run()
        monkeypatch.setattr(hybrid, "PAIRS", 50)
        assert run() == whole and len(whole) == 2 * 12 * 6


def test_lexical_is_bm25_of_the_patients_rows(spark):
    asked, obs = tables(spark)
    docs = obs.select(F.col("evidence_id").alias("doc_id"), "patient_id", hybrid.evidence_text(obs.columns).alias("text"))
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(asked.select("query_id", "patient_id", F.col("raw_query").alias("text")), docs, scope=["patient_id"]).collect()}
    q, rows = hybrid._with_words(asked, obs)
    pairs = hybrid.pairs_of(q, rows, F.lit(False)).select("query_id", "evidence_id", hybrid.lexical().alias("s")).filter("s is not null").collect()
    got = {(r["query_id"], r["evidence_id"]): r["s"] for r in pairs}
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_pairs_are_not_shuffled(spark):
    asked, obs = tables(spark)
    df = hybrid.retrieve_evidence(asked, obs, {"concept": 0.4, "temporal": 0.4, "intent": 0.2}, 5, F.col("value") > 200)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # one shuffle for each side of the join, none above it
    assert plan.count("Exchange hashpartitioning") == 2
