"""Hand-made series: single points, ties, zero baselines, nulls, other patients' rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import scalar
from seriesmill.operators import relational, series

T = lambda d: datetime.datetime(2024, 1, d)
ROWS = [
    ("a", "x", T(1), 0.0, 1), ("a", "x", T(2), 5.0, 2), ("a", "x", T(2), 9.0, 3), ("a", "x", T(4), 4.0, 4),
    ("a", "y", T(3), 7.0, 5), ("b", "x", T(1), 3.0, 6), ("b", "x", T(2), 3.0, 7), ("b", "x", T(3), None, 8),
]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(ROWS, "patient_id string, analyte string, ts timestamp_ntz, value double, evidence_id long")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_latest_breaks_ties_by_id(obs):
    assert rows(series.latest(obs), "patient_id", "analyte", "evidence_id") == [("a", "x", 4), ("a", "y", 5), ("b", "x", 8)]


def test_previous_keeps_a_single_row_as_primary(obs):
    assert ("a", "y", 5, "primary") in rows(series.previous(obs), "patient_id", "analyte", "evidence_id", "role")


def test_zero_baseline_has_no_relative_change(obs):
    got = {(r["patient_id"], r["analyte"]): r for r in series.trajectory_features(obs).collect()}
    assert got["a", "x"]["relative_change"] is None and got["a", "x"]["direction"] == "increasing"
    assert (got["a", "y"]["direction"], got["a", "y"]["consistency"], got["a", "y"]["monotonicity"]) == ("stable", 1.0, 1.0)
    assert got["b", "x"]["direction"] == "stable" and got["b", "x"]["n"] == 3  # rows without a value count


def test_inflection_is_the_farthest_interior_point(obs):
    assert rows(series.inflection(obs), "patient_id", "evidence_id") == [("a", 3)]


def test_cusum_equals_the_sequential_fold(obs, spark):
    values = [1.0, 2.0, 1.5, 9.0, 9.5, 0.5, 4.0]
    df = spark.createDataFrame([("p", "x", T(i + 1), v, i) for i, v in enumerate(values)], obs.schema)
    past = values[:-1]
    mean = sum(past) / len(past)
    std = (sum((v - mean) ** 2 for v in past) / len(past)) ** 0.5
    up = down = 0.0
    for v in values:
        z = (v - mean) / std
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
    got = series.cusum(df).first()
    assert got["s_up"] == pytest.approx(up, abs=1e-3) and got["s_down"] == pytest.approx(down, abs=1e-3)


def test_scope_refuses_none_and_empty_has_no_rows(obs):
    with pytest.raises(ValueError):
        relational.scope_filter(obs, None)
    assert relational.scope_filter(obs, "").count() == 0
    assert {r["patient_id"] for r in relational.scope_filter(obs, "b").collect()} == {"b"}


def test_gate_never_revives_a_zero(spark):
    df = spark.createDataFrame([(1, 0.0, True, True), (1, 0.7, False, True), (2, 0.4, False, True)], "q int, score double, inside boolean, explicit boolean")
    assert rows(relational.hard_gate(df, "q", "inside", "explicit"), "q", "score") == [(1, 0.0), (1, 0.0), (2, 0.4)]


def test_dates_and_numbers_from_text(spark):
    texts = ["2024-02-30", "31/12/2023", "12/31/2023", "3 Feb 2021", "<5", "positive", None, "1,5"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(scalar.parse_date_any(F.col("s")).cast("string"), scalar.parse_numeric_value(F.col("s")), scalar.parse_number(F.col("s")).cast("double")).collect()
    assert [r[0] for r in got] == [None, "2023-12-31", "2023-12-31", "2021-02-03", None, None, None, None]
    assert got[4][1] == 5.0 and got[5][1] is None and got[7][2] == 1.5


def test_pseudonym_is_hmac(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(scalar.pseudonym(F.lit("abc"), b"key")).first()[0]
    assert got == hmac.new(b"key", b"abc", hashlib.sha256).hexdigest()


def test_word_error(spark):
    got = spark.range(1).select(scalar.word_error_accuracy(F.lit("a b c d"), F.lit("a x c")), scalar.word_error_accuracy(F.lit("a"), F.lit("b c d"))).first()
    assert got[0] == pytest.approx(0.5) and got[1] == 0.0


def test_empty_tables(obs):
    empty = obs.filter("false")
    for f in (series.latest, series.previous, series.trajectory_features, series.cusum, series.monitor, series.inflection, series.lag_features):
        assert f(empty).count() == 0


def test_terms_map_to_the_nearest_alias_or_stay_unknown(spark):
    from seriesmill.operators import extraction

    vocabulary = spark.createDataFrame([("hemoglobin", "Hb"), ("creatinine", "Cr"), ("platelets", "Plt")], "alias string, label string")
    raw = spark.createDataFrame([(1, "HEMOGLOBIN"), (2, "hemoglobine"), (3, "creatinin"), (4, "zzz")], "id int, name string")
    got = {r["id"]: r["label"] for r in extraction.normalise_terms(raw, vocabulary).collect()}
    assert got == {1: "Hb", 2: "Hb", 3: "Cr", 4: "unknown"}


def told(spark, obs, values):
    return spark.createDataFrame([("p", "x", T(i + 1), v, i) for i, v in enumerate(values)], obs.schema)


def test_trajectory_by_hand(obs, spark):
    got = series.trajectory_features(told(spark, obs, [10.0, 10.2, 9.8, 10.4])).first()
    assert (got["direction"], got["delta"], got["relative_change"], got["slope_per_day"]) == ("increasing", 0.4, 0.04, pytest.approx(0.133333))
    # two rises, one fall; farthest from the line between the ends is the third value
    assert (got["consistency"], got["monotonicity"], got["inflection_id"]) == (0.6667, 0.3333, 2)
    flat = series.trajectory_features(told(spark, obs, [5.0, 5.0, 5.0])).first()
    assert (flat["direction"], flat["consistency"], flat["monotonicity"], flat["inflection_id"], flat["inflection_deviation"]) == ("stable", 1.0, 1.0, None, 0.0)


def test_monitor_by_hand(obs, spark):
    # the past has mean 10 and deviation 0.1414, so the last value's z is 2.83, and its score 1 - 2 * 2.83 / 3
    got = series.monitor(told(spark, obs, [10.0, 10.2, 9.8, 10.0, 10.4])).first()
    assert got["alarm"] and got["triggers"] == "causal_z" and got["causal_z"] == pytest.approx(2.8284, abs=1e-4) and got["score"] == pytest.approx(-0.8856, abs=1e-4)
    # a flat past: the change alone is a trigger, but no alarm
    got = series.monitor(told(spark, obs, [10.0, 10.0, 10.0, 14.0])).first()
    assert (got["alarm"], got["triggers"], got["causal_z"], got["pct_delta"], got["score"]) == (False, "pct_delta", 0.0, 0.4, pytest.approx(-0.6))
    got = series.monitor(told(spark, obs, [10.0, 99.0])).first()
    assert (got["alarm"], got["score"], got["method"]) == (False, 0.0, "zscore_fallback")


def test_zscore_trend_by_hand(obs, spark):
    got = series.zscore_trend(told(spark, obs, [1.0, 2.0, 3.0])).first()
    assert (got["trend"], got["z"], got["mean"], got["std"], got["streak"]) == ("rising", 1.225, 2.0, 0.8165, 0)
    got = series.zscore_trend(told(spark, obs, [1.0, 2.0])).first()
    assert (got["trend"], got["z"], got["streak"]) == ("insufficient_data", None, 0)


def test_anchors_fill_the_slots_farthest_in_time_first(obs, spark):
    day = [1, 20, 40, 41, 60, 80, 120]
    rows_ = [("p", "x", T(1) + datetime.timedelta(days=d), 50.0 if k == 2 else 1.0, k) for k, d in enumerate(day)]
    got = rows(series.trend_anchors(spark.createDataFrame(rows_, obs.schema)), "evidence_id", "role")
    assert got == [(0, "baseline"), (2, "inflection_point"), (4, "intermediate_milestone"), (5, "intermediate_milestone"), (6, "endpoint")]
