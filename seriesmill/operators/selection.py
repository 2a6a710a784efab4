"""Evidence for typed questions: which rows of a subject's series answer each, by the question's intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import micros, newest, ordered, trend_anchors, whole

#: A typed question. ``wanted`` is the number of rows asked for; ``against`` what a comparison is with (period, previous).
QUESTION = (
    "query_id long, patient_id long, analyte string, raw_query string, intent string, operator string, wanted int, against string, abnormal_only boolean, "
    "start_ts timestamp_ntz, end_ts timestamp_ntz"
)
_DATE = r"\b(?:20\d{2}|19\d{2})-\d{1,2}-\d{1,2}\b"


def mode() -> Column:
    """The way of selection. The order of the rules matters: each takes what those before it left; a null never decides."""
    raw, intent = F.lower(F.coalesce("raw_query", F.lit(""))), F.upper(F.coalesce("intent", F.lit("")))
    operator, against = F.upper(F.coalesce("operator", F.lit(""))), F.upper(F.coalesce("against", F.lit("")))
    says = lambda *words: raw.rlike("|".join(words))
    means = intent.contains
    dated = F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()
    compares = means("COMPARISON") | says("compare")
    trend = says("trend", "over time")
    past = means("PREVIOUS") | (against == "PREVIOUS") & ~means("TREND") | says("previous reading", "prior to the latest", "before the latest", "last reading before")
    now = means("CURRENT") | (operator == "LATEST") | says("most recent", "latest", "current", "last reading")
    odd = means("ABNORMAL") | F.coalesce("abnormal_only", F.lit(False)) | says("abnormal", "out of range", "high", "low", "elevated", "flagged")
    return (
        F.when(means("LAST_N") | (operator == "LAST_N") | (F.coalesce("wanted", F.lit(0)) > 1), "last_n")
        .when(means("DATE_COMPARISON") | compares & ((against == "PERIOD") | dated | (F.regexp_count(raw, F.lit(_DATE)) >= 2)), "dates")
        .when(past & ~trend, "previous").when(now & ~trend & ~says("last 3", "last 5", "last n"), "current")
        .when(odd & says("first", "when did", "when was"), "first_abnormal").when(odd, "abnormal")
        .when(means("HISTORICAL") | operator.isin("BETWEEN", "BEFORE", "AFTER", "SINCE", "EXACT_DATE"), "interval").otherwise("trend")
    )


def _nearest(t: str) -> Column:
    """evidence_id of the row nearest to the question's time; ties to the earliest, then the least id."""
    return F.min_by("evidence_id", F.struct(F.abs(micros("ts") - micros(t)), "ts", "evidence_id")).over(whole(["query_id"]))


def select_evidence(questions: DataFrame, observations: DataFrame, abnormal: Column, most: int = 10) -> DataFrame:
    """questions (``QUESTION``) and observations (patient_id, analyte, ts, value, evidence_id) -> query_id, mode, evidence_id, ts,
    value, role, is_primary. Only rows of the question's own patient and analyte are seen. A question whose way finds
    nothing takes its newest row; one without any row isn't in the result."""
    asked = questions.withColumn("mode", mode()).select("query_id", "patient_id", "analyte", "wanted", "start_ts", "end_ts", "mode")
    seen = asked.join(observations, ["patient_id", "analyte"]).withColumn("bad", F.coalesce(abnormal, F.lit(False)))
    key, every = ["query_id"], whole(["query_id"])
    bad_so_far = F.count_if("bad").over(ordered(key).rowsBetween(Window.unboundedPreceding, 0))
    at = seen.filter("mode <> 'trend'").withColumns({
        "rn": F.row_number().over(ordered(key)), "back": F.row_number().over(newest(key)), "n": F.count(F.lit(1)).over(every), "bads": F.count_if("bad").over(every), "nth_bad": bad_so_far,
        "a": F.when(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull(), _nearest("start_ts")), "b": F.when(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull(), _nearest("end_ts")),
    })
    m = F.least(F.greatest(F.coalesce("wanted", F.lit(3)), F.lit(1)), F.col("n"))
    is_ = lambda name: F.col("mode") == name
    single, newest_row = F.col("n") == 1, F.col("back") == 1
    dates = (
        F.when(F.col("n") <= 2, "comparison_anchor").when(F.col("evidence_id") == F.col("a"), "comparison_date_a").when(F.col("evidence_id") == F.col("b"), "comparison_date_b")
        .when(F.col("a").isNull() & (F.col("rn") == 1), "comparison_baseline").when(F.col("a").isNull() & newest_row, "comparison_endpoint")
    )
    none_bad = F.when((F.col("bads") == 0) & newest_row, "no_abnormality_detected")
    role = (
        F.when(is_("last_n"), F.when(F.col("back") <= m, F.format_string("last_n_%d_of_%d", m - F.col("back") + 1, m)))
        .when(is_("dates"), dates)
        .when(is_("previous"), F.when(single, "only_observation_available").when(newest_row, "reference_latest").when(F.col("back") == 2, "predecessor"))
        .when(is_("current"), F.when(newest_row, "latest"))
        .when(is_("first_abnormal"), F.when(F.col("bad") & (F.col("nth_bad") == 1), "first_abnormal").otherwise(none_bad))
        .when(is_("abnormal"), F.when(F.col("bad"), "abnormal").otherwise(none_bad))
        .when(is_("interval"), F.when(F.col("rn") == 1, "interval_start").when(newest_row, "interval_end").otherwise("interval_intermediate"))
    )
    columns = ["query_id", "mode", "evidence_id", "ts", "value", "role"]
    stepwise = at.withColumn("role", role).filter("role is not null").select(columns)
    trending = seen.filter("mode = 'trend'")
    anchors = trend_anchors(trending, most, keys=key).withColumn("mode", F.lit("trend")).select(columns)
    # a trend whose rows all lack a value has no anchors
    bare = trending.groupBy("query_id").agg(F.count("value").alias("valued"), F.max_by(F.struct("evidence_id", "ts", "value"), F.struct("ts", "evidence_id")).alias("r"))
    fallback = bare.filter("valued = 0").select("query_id", F.lit("trend").alias("mode"), "r.*", F.lit("fallback_latest").alias("role"))
    second = ["reference_latest", "no_abnormality_detected", "intermediate_milestone"]
    return stepwise.unionByName(anchors).unionByName(fallback).withColumn("is_primary", ~F.col("role").isin(second))
