"""Evidence by intent and the feature table, by cases worked out by hand."""

from pyspark.sql import functions as F

from seriesmill.operators import features, selection

_SERIES = [(1, "glucose", f"2024-{m:02d}-10", v, m) for m, v in ((1, 5.0), (2, 9.0), (3, 5.5), (4, 8.0), (5, 6.0))]


def observations(spark):
    rows = [*_SERIES, (1, "other", "2024-06-01", 1.0, 6), (2, "glucose", "2024-06-01", 99.0, 7), (3, "glucose", "2024-06-01", None, 8)]
    df = spark.createDataFrame(rows, "patient_id long, analyte string, day string, value double, evidence_id long")
    return df.select("patient_id", "analyte", F.col("day").cast("timestamp_ntz").alias("ts"), "value", "evidence_id")


def ask(spark, **given):
    names = [c.split()[0] for c in selection.QUESTION.split(", ")]
    row = {"query_id": 1, "patient_id": 1, "analyte": "glucose"} | given
    kinds = selection.QUESTION.replace("timestamp_ntz", "string")
    q = spark.createDataFrame([tuple(row.get(n) for n in names)], kinds)
    q = q.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("start_ts", "end_ts")})
    got = selection.select_evidence(q, observations(spark), F.col("value") > 7).orderBy("ts").collect()
    return [(r["evidence_id"], r["role"], r["is_primary"]) for r in got]


def test_each_intent_takes_its_own_rows(spark):
    assert ask(spark, wanted=2) == [(4, "last_n_1_of_2", True), (5, "last_n_2_of_2", True)]
    assert ask(spark, intent="DATE_COMPARISON", start_ts="2024-02-01", end_ts="2024-04-20") == [(2, "comparison_date_a", True), (4, "comparison_date_b", True)]
    assert ask(spark, raw_query="compare 2024-01-01 with 2024-05-01") == [(1, "comparison_baseline", True), (5, "comparison_endpoint", True)]
    assert ask(spark, intent="PREVIOUS_VALUE") == [(4, "predecessor", True), (5, "reference_latest", False)]
    assert ask(spark, raw_query="The LATEST value") == [(5, "latest", True)]
    assert ask(spark, raw_query="when was it abnormal") == [(2, "first_abnormal", True)]
    assert ask(spark, abnormal_only=True) == [(2, "abnormal", True), (4, "abnormal", True)]
    assert ask(spark, analyte="other", abnormal_only=True) == [(6, "no_abnormality_detected", False)]
    assert ask(spark, operator="SINCE")[1:] == [(2, "interval_intermediate", True), (3, "interval_intermediate", True), (4, "interval_intermediate", True), (5, "interval_end", True)]
    assert [r[:2] for r in ask(spark)] == [(1, "baseline"), (2, "inflection_point"), (3, "intermediate_milestone"), (4, "intermediate_milestone"), (5, "endpoint")]
    assert [r[2] for r in ask(spark)] == [True, True, False, False, True]


def test_order_of_the_rules_and_what_lacks(spark):
    assert ask(spark, raw_query="latest trend", intent="CURRENT")[0] == (1, "baseline", True)
    assert ask(spark, patient_id=3) == [(8, "fallback_latest", True)]
    assert ask(spark, patient_id=9) == []


def test_feature_table(spark):
    rows = [(1, "hba1c", "2024-01-01", 5.4, 1), (1, "hba1c", "2024-01-11", 7.4, 2), (1, "alt", "2024-01-01", 40.0, 3), (1, "ast", "2024-01-01", 20.0, 4), (1, "hdl", "2024-01-01", None, 5), (2, "x", "2024-01-01", 1.0, 6)]
    metrics = spark.createDataFrame(rows, "patient_id long, analyte string, day string, value double, evidence_id long").withColumn("ts", F.to_timestamp("day"))
    people = spark.createDataFrame([(1, 50, " Woman ")], "patient_id long, age int, sex string")
    one, two = features.feature_table(metrics, people).orderBy("patient_id").collect()
    assert (one["age"], one["sex_female"], one["hba1c"], one["hba1c_slope"], one["alt_slope"], one["ast_alt_ratio"], one["hdl"]) == (50.0, 1.0, 7.4, 0.2, 0.0, 0.5, None)
    assert (one["n_recent_labs"], one["risk_mean_proxy"], one["risk_max_proxy"], one["forecast_worsening_proxy"], one["trend_penalty"]) == (3.0, 0.25, 0.5, 1.0, 20.0)
    assert (two["age"], two["sex_female"], two["missing_fraction"], two["risk_mean_proxy"], two["forecast_worsening_proxy"]) == (None, 0.5, 1.0, 0.35, 0.0)
    assert features.feature_table(metrics.filter("false")).count() == 0
