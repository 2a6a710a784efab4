"""Evidence by five scores, on a patient's rows by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import hybrid, selection

T = lambda d: datetime.datetime(2024, 1, d)
OBS = "patient_id long, analyte string, ts timestamp_ntz, value double, evidence_id string, unit string, flag string"
ROWS = [
    (1, "Glucose", T(1), 90.0, "g1", "mg/dL", None), (1, "Glucose", T(5), 250.0, "g2", "mg/dL", "high"), (1, "Glucose", T(9), 240.0, "g3", "mg/dL", "high"), (1, "Sodium", T(7), 300.0, "s1", "mmol/L", "high"),
    (1, "Sodium", T(8), 140.0, "s2", "mmol/L", None), (2, "Glucose", T(3), 99.0, "other", "mg/dL", None),
]


def ask(spark, **over):
    base = dict(query_id=1, patient_id=1, analyte="glucose", raw_query="glucose", intent=None, operator=None, wanted=None, against=None, abnormal_only=None, start_ts=None, end_ts=None)
    row = {**base, **over}
    return spark.createDataFrame([tuple(row[c] for c in base)], selection.QUESTION)


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(ROWS, OBS).repartition(3).cache()


def scores(df, name):
    return {r["evidence_id"]: r[name] for r in df.collect()}


@pytest.mark.parametrize(
    ("over", "want"),
    [
        (dict(intent="CURRENT_VALUE"), {"g3": 1.0, "g2": 0.333333, "g1": 0.2, "s1": 0.0, "s2": 0.0}),
        (dict(operator="LAST_N", wanted=2), {"g3": 1.0, "g2": 0.95, "g1": 0.1, "s1": 0.0, "s2": 0.0}),
        (dict(intent="COMPARISON", against="PREVIOUS"), {"g3": 0.5, "g2": 1.0, "g1": 0.0, "s1": 0.0, "s2": 0.0}),
        (dict(intent="COMPARISON", start_ts=T(1), end_ts=T(8)), {"g3": 0.0, "g2": 0.0, "g1": 1.0, "s1": 0.0, "s2": 1.0}),
        (dict(intent="TREND"), {"g3": 1.0, "g2": 1.0, "g1": 1.0, "s1": 0.0, "s2": 0.0}),
        (dict(operator="BETWEEN", start_ts=T(5), end_ts=T(7)), {"g3": 0.0, "g2": 1.0, "g1": 0.0, "s1": 1.0, "s2": 0.0}),
        (dict(operator="EXACT_DATE", start_ts=T(5)), {"g3": 0.0, "g2": 1.0, "g1": 0.0, "s1": 0.0, "s2": 0.0}),
        (dict(operator="SINCE", start_ts=T(8)), {"g3": 1.0, "g2": 0.0, "g1": 0.0, "s1": 0.0, "s2": 1.0}),
        (dict(operator="BEFORE", end_ts=T(5)), {"g3": 0.0, "g2": 1.0, "g1": 1.0, "s1": 0.0, "s2": 0.0}),
        (dict(), dict.fromkeys(("g1", "g2", "g3", "s1", "s2"), 0.5)),
        (dict(analyte="iron", intent="CURRENT_VALUE"), {"g3": 1.0, "s2": 0.333333, "s1": 0.2, "g2": 0.142857, "g1": 0.111111}),
    ],
)
def test_time(spark, obs, over, want):
    got = hybrid.retrieve_evidence(ask(spark, **over), obs, {"temporal": 1.0}, gate=False)
    assert scores(got, "temporal") == want and scores(got, "score") == want


@pytest.mark.parametrize(
    ("over", "want"),
    [
        (dict(), dict.fromkeys(("g1", "g2", "g3", "s1", "s2"), 1.0)),
        (dict(abnormal_only=True), {"g1": 0.0, "g2": 1.0, "g3": 1.0, "s1": 1.0, "s2": 0.0}),
        (dict(raw_query="first abnormal glucose"), {"g1": 0.0, "g2": 1.0, "g3": 0.5, "s1": 0.5, "s2": 0.0}),
        (dict(raw_query="first abnormal one", analyte=None), {"g1": 0.0, "g2": 1.0, "g3": 0.5, "s1": 0.5, "s2": 0.0}),
        (dict(raw_query="first abnormal iron", analyte="iron"), {"g1": 0.0, "g2": 1.0, "g3": 1.0, "s1": 1.0, "s2": 0.0}),
    ],
)
def test_abnormal(spark, obs, over, want):
    assert scores(hybrid.retrieve_evidence(ask(spark, **over), obs, {"intent": 1.0}, abnormal=F.col("value") > 200), "intent") == want


def test_measure_words_and_grams(spark, obs):
    got = hybrid.retrieve_evidence(ask(spark, raw_query="show glucose high"), obs, {"lexical": 0.4, "semantic": 0.3, "concept": 0.3}).collect()
    by = {r["evidence_id"]: r for r in got}
    assert {i: r["concept"] for i, r in by.items()} == {"g1": 0.95, "g2": 0.95, "g3": 0.95, "s1": 0.0, "s2": 0.0}
    assert by["g2"]["lexical"] == by["g3"]["lexical"] == 1.0 and 0 < by["s1"]["lexical"] < 1 and by["s2"]["lexical"] == 0.0
    assert by["g1"]["semantic"] > 0.4 > by["s1"]["semantic"]
    assert [r["evidence_id"] for r in sorted(got, key=lambda r: r["rank"])][:2] == ["g3", "g2"]  # ties to the newer row
    assert "other" not in by and by["g1"]["temporal"] is None


def test_dates_shut_others_out_and_ranks_fuse(spark, obs):
    dated = ask(spark, operator="BETWEEN", start_ts=T(5), end_ts=T(6))
    got = scores(hybrid.retrieve_evidence(dated, obs, {"concept": 0.5, "temporal": 0.5}), "score")
    assert got == {"g2": 0.975, "g1": 0.0, "g3": 0.0, "s1": 0.0, "s2": 0.0}
    none = ask(spark, operator="BETWEEN", start_ts=T(20), end_ts=T(21))
    assert scores(hybrid.retrieve_evidence(none, obs, {"concept": 0.5, "temporal": 0.5}), "score")["g1"] == 0.475
    ranked = hybrid.retrieve_evidence(ask(spark, raw_query="glucose high"), obs, {"lexical": 0.5, "semantic": 0.5}, k=2, by_rank=True).collect()
    assert [r["evidence_id"] for r in sorted(ranked, key=lambda r: r["rank"])] == ["g3", "g2"] and max(r["score"] for r in ranked) == 1.0


def test_no_rows(spark, obs):
    full = {"lexical": 0.2, "semantic": 0.2, "concept": 0.25, "temporal": 0.25, "intent": 0.1}
    assert hybrid.retrieve_evidence(ask(spark, patient_id=9), obs, full).count() == 0
    assert hybrid.retrieve_evidence(ask(spark, raw_query=None, analyte=None), obs, full).count() == 5
