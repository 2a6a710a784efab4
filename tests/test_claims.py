"""Facts, sentences and their checks on hand-made evidence."""

import datetime

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import claims

T = lambda d: datetime.datetime(2024, 1, d)
SELECTED = "query_id long, mode string, evidence_id string, ts timestamp_ntz, value double, role string, is_primary boolean, flag string"
ROWS = [
    (1, "trend", "a", T(1), 100.0, "baseline", True, None), (1, "trend", "b", T(5), 180.0, "inflection_point", True, "high"), (1, "trend", "c", T(11), 120.0, "endpoint", True, None),
    (2, "previous", "d", T(2), 5.5, "predecessor", True, None), (2, "previous", "e", T(3), 4.25, "reference_latest", False, None),
    (3, "current", "f", T(4), 7.0, "latest", True, "High"),
    (4, "last_n", "g", T(1), 1.5, "last_n_1_of_2", True, None), (4, "last_n", "h", T(2), 1.5, "last_n_2_of_2", True, None),
    (5, "abnormal", "i", T(9), 300.0, "abnormal", True, "high"), (5, "abnormal", "j", T(8), 250.0, "abnormal", True, "high"),
    (6, "abnormal", "k", T(9), 90.0, "no_abnormality_detected", False, None),
    (7, "dates", "l", T(1), 0.0, "comparison_date_a", True, None), (7, "dates", "m", T(1), 8.0, "comparison_date_b", True, None),
    (8, "interval", "n", T(1), None, "interval_start", True, None), (8, "interval", "o", T(3), 10.0, "interval_intermediate", True, None), (8, "interval", "p", T(4), 20.0, "interval_end", True, None),
    (9, "trend", "q", T(1), 3.0, "single_observation", True, None), (10, "current", "r", T(1), None, "latest", True, None),
]


@pytest.fixture(scope="module")
def selected(spark):
    return spark.createDataFrame(ROWS, SELECTED).repartition(3).cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(i, f"M{i}") for i in range(1, 11)], "query_id long, analyte string")


@pytest.fixture(scope="module")
def facts(selected):
    return claims.derived_facts(selected).cache()


def test_facts_with_their_contributors(facts):
    got = {(r["query_id"], r["fact"]): (r["word"] if r["fact"] == "direction" else r["value"], r["contributors"]) for r in facts.collect()}
    assert got[1, "span_days"] == (10.0, ["a", "c"]) and got[1, "absolute_delta"] == (20.0, ["a", "c"]) and got[1, "relative_change_pct"] == (20.0, ["a", "c"])
    assert got[1, "direction"] == ("increased", ["a", "c"]) and got[1, "slope_per_day"] == (2.0, ["a", "c"])
    assert got[1, "min_value"] == (100.0, ["a"]) and got[1, "max_value"] == (180.0, ["b"]) and got[1, "inflection_point"] == (72.0, ["a", "b", "c"])
    assert got[2, "direction"] == ("decreased", ["d", "e"]) and got[2, "relative_change_pct"] == (-22.73, ["d", "e"])
    assert got[4, "direction"] == ("stable", ["g", "h"]) and got[4, "min_value"] == (1.5, ["g"])
    assert (7, "relative_change_pct") not in got and (7, "slope_per_day") not in got and got[7, "span_days"] == (0.0, ["l", "m"])
    assert got[8, "absolute_delta"] == (10.0, ["o", "p"])  # rows without a value contribute nothing
    assert got[9, "span_days"] == (0.0, ["q"]) and not [k for k in got if k[0] == 10]


def test_sentences_by_mode_with_sources(selected, questions):
    got = {(r["query_id"], r["place"]): (r["sentence"], r["cited"]) for r in claims.claims(selected, questions).collect()}
    assert got == {
        (1, 1): ("M1 went from 100 on 2024-01-01 [a] to 120 on 2024-01-11 [c].", ["a", "c"]), (1, 2): ("It turned at 180 on 2024-01-05 [b].", ["b"]), (1, 3): ("Overall, M1 increased by 20 over 10 days [a, c].", ["a", "c"]),
        (2, 1): ("Before the latest test, M2 was 5.5 on 2024-01-02 [d].", ["d"]), (2, 2): ("The latest M2 is 4.25, of 2024-01-03 [e].", ["e"]), (2, 3): ("Between the two, M2 decreased by 1.25 [d, e].", ["d", "e"]),
        (3, 1): ("The latest M3 is 7, measured on 2024-01-04 [f].", ["f"]), (3, 2): ("It was flagged as High [f].", ["f"]),
        (4, 1): ("The last 2 values of M4: 1.5 on 2024-01-01 [g], 1.5 on 2024-01-02 [h].", ["g", "h"]), (4, 2): ("Over these 2 values, M4 stable by 0 [g, h].", ["g", "h"]),
        (5, 1): ("The first abnormal M5 on record is 250, of 2024-01-08 [j].", ["j"]), (6, 1): ("No abnormal M6 was found; the latest is 90, of 2024-01-09 [k].", ["k"]),
        (7, 1): ("M7 was 0 on 2024-01-01 [l] and 8 on 2024-01-01 [m].", ["l", "m"]), (7, 2): ("It increased by 8 over 0 days [l, m].", ["l", "m"]),
        (8, 1): ("From 2024-01-01 to 2024-01-04, 3 values of M8 were recorded [n, p].", ["n", "p"]), (8, 2): ("M8 increased from unknown to 20 [n, p].", ["n", "p"]),
        (9, 1): ("The latest M9 is 3, measured on 2024-01-01 [q].", ["q"]), (10, 1): ("The latest M10 is unknown, measured on 2024-01-01 [r].", ["r"]),
    }


def test_own_claims_stand_on_their_evidence(selected, questions, facts):
    checked = claims.verify_claims(claims.claims(selected, questions), selected, facts)
    assert checked.filter("not grounded").count() == 0 and checked.count() == 18
    got = {r["query_id"]: (r["claims"], r["grounding_rate"], r["utilisation"], r["hallucination"]) for r in claims.audit(checked, selected).collect()}
    assert got[1] == (3, 1.0, 1.0, False) and got[5] == (1, 1.0, 0.5, False) and got[8] == (2, 1.0, 0.666667, False)


@pytest.mark.parametrize(
    ("query", "sentence", "cited", "reasons"),
    [
        (1, "It rose from 100 to 120 [a, c].", ["a", "c"], []),
        (1, "It rose by 20 % or 2 a day over 10 days.", ["a", "c"], []),
        (1, "It fell by -20.", ["a", "c"], []),
        (1, "It rose to 121 on 2024-01-11.", ["a", "c"], ["number not in evidence: 121"]),
        (1, "On 11/01/2024 it was 120.005.", ["c"], []),
        (1, "On 12/01/2024 it was 120.", ["c"], ["date not in evidence: 12/01/2024"]),
        (1, "It was 100 on 2024-01-01.", ["c"], ["date not in evidence: 2024-01-01", "number not in evidence: 100"]),
        (1, "It peaked at 180, 72 off the line.", ["a", "b", "c"], []),
        (1, "It was 120.", [], ["no evidence cited"]),
        (1, "It was 120.", ["c", "zz", "d"], ["evidence not selected: d", "evidence not selected: zz"]),
        (1, "Three of 14 results [x9].", ["c"], []),
        (99, "Nothing is known.", ["a"], ["evidence not selected: a"]),
    ],
)
def test_reasons(spark, selected, facts, query, sentence, cited, reasons):
    told = spark.createDataFrame([(query, 1, sentence, cited)], "query_id long, place int, sentence string, cited array<string>")
    r = claims.verify_claims(told, selected, facts).first()
    assert (r["reasons"], r["grounded"]) == (reasons, not reasons)


def test_nothing_selected(selected, questions):
    none = selected.filter(F.lit(False))
    assert claims.derived_facts(none).count() == 0 and claims.claims(none, questions).count() == 0
    assert claims.verify_claims(claims.claims(none, questions), none, claims.derived_facts(none)).count() == 0
