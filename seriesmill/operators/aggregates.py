"""Summaries: grouped aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_audit(df: DataFrame) -> DataFrame:
    """One row of counters over an observation table."""
    pairs = df.groupBy("patient_id", "analyte").agg(F.count(F.lit(1)).alias("c"))
    long_ = pairs.filter("c >= 2").agg(F.countDistinct("patient_id").alias("longitudinal_patients"))
    same = df.groupBy("patient_id", "analyte", "ts", "value").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    out = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("patient_id").alias("n_patients"), F.countDistinct("analyte").alias("n_analytes"), F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"),
        F.count_if(F.col("ts").isNull()).alias("missing_dates"), F.count_if(F.col("value").isNull()).alias("missing_values"), F.round(F.avg(F.col("value").isNotNull().cast("int")) * 100, 4).alias("coverage_pct"),
    )
    return out.crossJoin(long_).crossJoin(same)  # one row each


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def longitudinal_keys(df: DataFrame, least: int = 2) -> DataFrame:
    """Patients with enough points on some analyte."""
    return df.groupBy("patient_id", "analyte").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("patient_id").distinct()


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def timeline_summary(df: DataFrame) -> DataFrame:
    """Per series: the latest value and its time, and the number of points."""
    return df.groupBy("patient_id", "analyte").agg(F.max_by(F.struct("value", "ts"), F.struct("ts", "evidence_id")).alias("r"), F.count(F.lit(1)).alias("n")).select("patient_id", "analyte", F.col("r.value").alias("latest"), F.col("r.ts").alias("latest_ts"), "n")


def latest_wide(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per patient, the latest value of each named analyte in a column of its own."""
    at = F.struct("ts", "evidence_id")
    cols = [F.max_by(F.when(F.col("analyte") == n, F.col("value")), F.when((F.col("analyte") == n) & F.col("value").isNotNull(), at)).alias(n) for n in names]
    return df.groupBy("patient_id").agg(*cols)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in columns))


def robust_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median and interquartile range (at least 0.001) of each column."""
    q = df.agg(*(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(c) for c in columns))
    return q.select(*(x for c in columns for x in (F.round(F.col(c)[1], 6).alias(f"{c}_median"), F.round(F.greatest(F.col(c)[2] - F.col(c)[0], F.lit(0.001)), 6).alias(f"{c}_iqr"))))


def storage_usage(df: DataFrame, owner: str, size: str, counted: Column) -> DataFrame:
    return df.groupBy(owner).agg(F.sum(F.coalesce(size, F.lit(0))).alias("used"), F.count(F.lit(1)).alias("files"), F.count_if(counted).alias("counted"))


def best_year(df: DataFrame) -> DataFrame:
    """Each series' year with most points; ties to the earlier year."""
    per = df.groupBy("patient_id", "analyte", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("patient_id", "analyte").agg(F.max_by(F.struct("year", "n"), F.struct("n", -F.col("year"))).alias("r")).select("patient_id", "analyte", "r.*")


def group_modes(df: DataFrame, flag: Column) -> DataFrame:
    """Per series: whether any row is abnormal, and the first one."""
    df = df.withColumn("bad", flag)
    return df.groupBy("patient_id", "analyte").agg(F.bool_or("bad").alias("any_abnormal"), F.min_by(F.when(F.col("bad"), F.col("evidence_id")), F.when(F.col("bad"), F.struct("ts", "evidence_id"))).alias("first_abnormal_id"))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation; null where a column is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form, to 3 places; undefined ones are 0."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    clean = lambda c: F.round(F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c), 3)
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), clean(F.col(f"`{a}|{b}`")).alias("r")) for a, b in pairs))
    return one.select(F.inline(rows))


def non_constant(df: DataFrame, columns: Sequence[str], least: float = 1e-9) -> DataFrame:
    one = df.agg(*(F.stddev_pop(c).alias(c) for c in columns))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(c), 6).alias("std")) for c in columns)))).filter(F.col("std") > least)


def select_by_correlation(df: DataFrame, columns: Sequence[str], y: str, n: int) -> DataFrame:
    """The n columns that go most with y; constant ones are out."""
    one = df.agg(*(x for c in columns for x in (correlation(c, y).alias(f"r_{c}"), F.stddev_pop(c).alias(f"s_{c}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.round(F.col(f"r_{c}"), 4).alias("r"), F.col(f"s_{c}").alias("s")) for c in columns))
    return one.select(F.inline(rows)).filter("s > 1e-9").orderBy(F.desc(F.abs("r")), "column").limit(n).select("column", "r")


def latency_summary(df: DataFrame, v: str) -> DataFrame:
    """Mean, nearest-rank p50 and p95, max. The nearest rank round(p (n - 1)) is exact: percentile merges counts by value,
    and at a whole rank nothing is interpolated."""
    n = df.agg(F.count(v)).first()[0]
    at = lambda p: F.percentile(v, F.lit(int(p * (n - 1) + 0.5) / max(n - 1, 1)))
    return df.agg(F.round(F.avg(v), 6).alias("mean"), F.round(at(0.5), 6).alias("p50"), F.round(at(0.95), 6).alias("p95"), F.max(v).alias("max"))


def cohort_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("patient_id").alias("patients"))


def unit_consistency(df: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """The set of units of each series; several can't be compared."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(unit)), ",").alias("units"), (F.countDistinct(unit) > 1).alias("mixed"))


def consultation_summary(rows: DataFrame, scopes: DataFrame, key: str, section: str, item: str) -> DataFrame:
    """Per patient: shared sections with their items, and the sections not shared."""
    per = rows.groupBy(key, section).agg(F.count(item).alias("n"))
    told = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(section, "n"))).alias("all"))
    out = told.join(scopes, key, "left").withColumn("scopes", F.coalesce("scopes", F.array().cast("array<string>")))
    text = lambda x: F.concat(x[section], F.lit("="), x["n"].cast("string"))
    shared = F.transform(F.filter("all", lambda x: F.array_contains("scopes", x[section])), text)
    return out.select(key, F.array_join(shared, ";").alias("sections"), F.array_join(F.array_sort(F.array_except(F.transform("all", lambda x: x[section]), "scopes")), ",").alias("unshared"))


def risk_rollup(conditions: DataFrame, key: str) -> DataFrame:
    """conditions (key, condition, probability): mean, the most likely one and its band."""
    agg = conditions.groupBy(key).agg(F.round(F.avg("probability"), 6).alias("mean_p"), F.max_by(F.struct("condition", "probability"), F.struct("probability", "condition")).alias("top"))
    band = F.when(F.col("top.probability") >= 0.66, "high").when(F.col("top.probability") >= 0.33, "moderate").otherwise("low")
    return agg.select(key, "mean_p", F.col("top.condition").alias("top_condition"), band.alias("band"))
