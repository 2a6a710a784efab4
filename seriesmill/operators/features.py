"""One row of model features for each patient, from named measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

# fixed values: the core labs, the labs with slopes, and each risk proxy's lab, threshold and width
CORE = ("hba1c", "fasting_glucose", "creatinine", "egfr", "alt", "ast", "ldl", "hdl", "triglycerides", "tsh", "hemoglobin")
SLOPES = ("hba1c", "creatinine", "alt", "hemoglobin")
RISES = {"hba1c": (5.4, 4.0), "creatinine": (0.9, 2.0), "alt": (40.0, 120.0)}
FALLS = {"hemoglobin": (13.5, 5.0)}
STRAYS = {"tsh": (2.0, 8.0)}
NO_RISK = 0.35


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _slope(lab: str) -> Column:
    """Least squares per whole day; 0 for fewer than two days."""
    own = (F.col("analyte") == lab) & F.col("value").isNotNull()
    day = F.unix_date(F.col("ts").cast("date")) - 20000.0  # near the data: sums of squares keep their digits
    return F.coalesce(F.regr_slope(F.when(own, F.col("value")), F.when(own, day)), F.lit(0.0))


def feature_table(metrics: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """metrics (patient_id, analyte by the names above, ts, value, evidence_id), people (patient_id, age, sex) -> per patient with
    metrics: the latest value of each lab, slopes, ratios, the share of core labs that lack, and proxies of risk and of
    worsening. Slopes are rounded to 8 places, what derives from them and all else that is computed to 6, by their first ten decimals. One shuffle
    of partial aggregates; ``people`` has one row per patient."""
    labs = (*CORE, "total_cholesterol")
    at = F.struct("ts", "evidence_id")
    last = [F.max_by(F.when(F.col("analyte") == n, F.col("value")), F.when((F.col("analyte") == n) & F.col("value").isNotNull(), at)).alias(n) for n in labs]
    df = metrics.groupBy("patient_id").agg(*last, *(scalar.round_half(_slope(n), 8).alias(f"{n}_slope") for n in SLOPES))
    if people is not None:
        df = df.join(people.select("patient_id", F.col("age").cast("double").alias("age"), F.lower(F.trim(F.col("sex").cast("string"))).alias("sex")), "patient_id", "left")
    else:
        df = df.withColumns({"age": F.lit(None).cast("double"), "sex": F.lit(None).cast("string")})
    risks = [
        *(_unit((F.col(n) - base) / width) for n, (base, width) in RISES.items()), *(_unit((base - F.col(n)) / width) for n, (base, width) in FALLS.items()),
        *(_unit(F.abs(F.col(n) - base) / width) for n, (base, width) in STRAYS.items()),
    ]
    # least and greatest skip nulls, so a lab that lacks must be told apart here
    names = [*RISES, *FALLS, *STRAYS]
    risk = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), r) for n, r in zip(names, risks, strict=True))))
    mean = F.aggregate("risks", F.lit(0.0), lambda a, b: a + b) / F.size("risks")
    none = F.size("risks") == 0
    present = sum((F.col(n).isNotNull().cast("int") for n in CORE), F.lit(0))
    up = sum((F.greatest(F.lit(0.0), F.col(f"{n}_slope")) for n in RISES), F.lit(0.0)) + F.greatest(F.lit(0.0), -F.col("hemoglobin_slope"))
    part = lambda a, b: F.when(F.col(b) > 0, scalar.round_half(F.col(a) / F.col(b), 6))
    female = F.when(F.col("sex").isin("f", "female", "woman", "1"), 1.0).when(F.col("sex").isin("m", "male", "man", "0"), 0.0).otherwise(0.5)
    return df.withColumns({"risks": risk, "up": up}).select(
        "patient_id", "age", female.alias("sex_female"), *labs, *(f"{n}_slope" for n in SLOPES), part("ast", "alt").alias("ast_alt_ratio"), part("total_cholesterol", "hdl").alias("tc_hdl_ratio"),
        F.when(F.col("hdl") > 0, scalar.round_half(F.col("total_cholesterol") - F.col("hdl"), 6)).alias("non_hdl"), present.cast("double").alias("n_recent_labs"),
        scalar.round_half(1 - present / len(CORE), 6).alias("missing_fraction"), F.when(none, NO_RISK).otherwise(scalar.round_half(mean, 6)).alias("risk_mean_proxy"),
        F.when(none, NO_RISK).otherwise(scalar.round_half(F.array_max("risks"), 6)).alias("risk_max_proxy"), scalar.round_half(F.least(F.lit(1.0), F.col("up") * 50), 6).alias("forecast_worsening_proxy"),
        scalar.round_half(F.least(F.lit(20.0), F.col("up") * 200), 6).alias("trend_penalty"),
    )
