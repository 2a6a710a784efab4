"""Splits and benchmark building, consent and care-record reports, feature tables and simple detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

SHARES = (("train", 0.6), ("dev", 0.2), ("test", 0.2))


def split_exact(df: DataFrame, key: str, shares: Sequence[tuple[str, float]] = SHARES, seed: int = 42) -> DataFrame:
    """Exact shares of the distinct keys, in order of SHA-256 of seed:key. Places come from counts per digest prefix, so the
    ordering is never one partition's work."""
    ids = df.select(key).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    part = ids.withColumn("part", F.substring("h", 1, 2))
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    placed = part.join(before, "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("h")) + F.col("before"))
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        test = F.col("place") <= F.round(upto * F.col("n"))
        out = F.when(test, name) if out is None else out.when(test, name)
    return placed.select(key, out.otherwise(shares[-1][0]).alias("split"))


def split_hash(df: DataFrame, key: str, shares: Sequence[tuple[str, float]] = SHARES, seed: int = 42) -> DataFrame:
    """Shares by hash bucket: no counting, and stable when keys are added."""
    bucket, out, upto = scalar.hash_bucket(F.col(key), seed), None, 0.0
    for name, share in shares[:-1]:
        upto += share
        test = bucket < F.lit(round(upto * 10000))
        out = F.when(test, name) if out is None else out.when(test, name)
    return df.select(key).distinct().select(key, out.otherwise(shares[-1][0]).alias("split"))


def query_candidates(df: DataFrame, abnormal: Column) -> DataFrame:
    """Per series, the question kinds it can answer, with the number of gold rows each would have."""
    s = df.groupBy("patient_id", "analyte").agg(F.count(F.lit(1)).alias("n"), F.count_if(abnormal).alias("bad"))
    kinds = F.array_compact(F.array(
        F.struct(F.lit("latest").alias("intent"), F.lit(1).cast("long").alias("gold")), F.when(F.col("n") >= 2, F.struct(F.lit("previous").alias("intent"), F.lit(2).cast("long").alias("gold"))),
        F.when(F.col("n") >= 3, F.struct(F.lit("last_n").alias("intent"), F.lit(3).cast("long").alias("gold"))), F.when(F.col("n") >= 3, F.struct(F.lit("trend").alias("intent"), F.col("n").alias("gold"))),
        F.when(F.col("bad") > 0, F.struct(F.lit("abnormal").alias("intent"), F.col("bad").alias("gold"))),
    ))
    return s.select("patient_id", "analyte", F.inline(kinds))


def sample_benchmark(candidates: DataFrame, per_intent: int) -> DataFrame:
    """The first candidates of each intent, patients taking turns: a patient's n-th candidate comes after all others' earlier ones."""
    turn = F.row_number().over(Window.partitionBy("intent", "patient_id").orderBy("analyte"))
    place = F.row_number().over(Window.partitionBy("intent").orderBy("turn", "patient_id", "analyte"))
    return candidates.withColumn("turn", turn).withColumn("place", place).filter(F.col("place") <= per_intent).drop("turn")


def grant_access(patients: DataFrame, grants: DataFrame, actor: int, scope: str, now: str) -> DataFrame:
    """Patients an actor may see: their own, those of a verified guardian while minor, and live grants with the scope."""
    live = grants.filter((F.col("recipient_id") == actor) & F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")) & F.array_contains("scopes", scope))
    granted = live.select("patient_id").distinct().withColumn("granted", F.lit(True))
    seen = patients.join(granted, "patient_id", "left")
    reason = F.when(F.col("patient_id") == actor, "owner").when((F.col("guardian_id") == actor) & F.col("guardian_verified") & F.col("minor"), "guardian").when(F.col("granted"), "grant")
    return seen.withColumn("reason", reason).filter("reason is not null").select("patient_id", "reason")


def active_grants(grants: DataFrame, now: str) -> DataFrame:
    return grants.filter(F.col("revoked_at").isNull() & (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))


def quota_check(files: DataFrame, owner: str, size: str, new_bytes: int, quota: int, limit: int) -> DataFrame:
    """Accounts that can't take another file: by bytes or by count."""
    per = files.groupBy(owner).agg(F.sum(F.coalesce(size, F.lit(0))).alias("used"), F.count(F.lit(1)).alias("files"))
    reason = F.when(F.col("used") + new_bytes > quota, "bytes").when(F.col("files") >= limit, "count")
    return per.withColumn("reason", reason)


def content_duplicates(files: DataFrame, content: str, key: str) -> DataFrame:
    return files.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def validate_rows(rows: DataFrame, doc: str, name: str, start: str, end: str, most: int) -> DataFrame:
    """Violations per row: duplicate names within a document, whatever the case; end before start; too many rows."""
    w = Window.partitionBy(doc)
    dup = F.count(F.lit(1)).over(Window.partitionBy(doc, F.lower(name))) > 1
    return rows.withColumn("violation", F.concat_ws(",", F.when(dup, "duplicate"), F.when(F.col(end) < F.col(start), "ends_early"), F.when(F.count(F.lit(1)).over(w) > most, "too_many"))).filter("violation <> ''")


def review_status(reports: DataFrame, lines: DataFrame, report: str, line_report: str) -> DataFrame:
    """Reports with candidate lines, and whether all of them are reviewed."""
    per = lines.groupBy(F.col(line_report).alias(report)).agg(F.count(F.lit(1)).alias("lines"), F.bool_and("reviewed").alias("reviewed"))
    return reports.join(per, report, "left").select(report, F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("reviewed", F.lit(False)).alias("reviewed"))


def next_due(rows: DataFrame, key: str, t: str, i: str, open_: Column, now: str) -> DataFrame:
    """Each patient's first open row after now."""
    return rows.filter(open_ & (F.col(t) > F.lit(now).cast("timestamp_ntz"))).groupBy(key).agg(F.min_by(F.struct(F.col(i), F.col(t)), F.struct(t, i)).alias("r")).select(key, "r.*")


def stale_leases(df: DataFrame, state: Column, t: str, now: str, minutes: int = 5) -> DataFrame:
    """Pending rows, and those in processing for longer than the lease; oldest first."""
    old = F.col(t) < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return df.filter((state == "pending") | ((state == "processing") & old)).orderBy(t)


def impute_and_scale(df: DataFrame, columns: Sequence[str], key: Sequence[str], digits: int = 6) -> DataFrame:
    """Median for what is missing, then (x - median) / IQR, IQR at least 0.001. The statistics are one row."""
    q = df.agg(*(F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q_{c}") for c in columns))
    mid = lambda c: F.col(f"q_{c}")[1]
    iqr = lambda c: F.greatest(F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0], F.lit(0.001))
    return df.crossJoin(F.broadcast(q)).select(*key, *(F.round((F.coalesce(F.col(c), mid(c)) - mid(c)) / iqr(c), digits).alias(c) for c in columns))


def robust_z_detector(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """The largest absolute scaled feature over 6, at most 1."""
    scaled = impute_and_scale(df, columns, key, 12)
    return scaled.select(*key, F.round(F.least(F.greatest(*(F.abs(c) for c in columns)) / 6.0, F.lit(1.0)), 6).alias("score"))


def profile_anomaly(df: DataFrame, columns: Sequence[str], key: Sequence[str], threshold: float = 0.5) -> DataFrame:
    scored = robust_z_detector(df, columns, key)
    return scored.withColumns({"category": scalar.band(F.col("score"), [(0.75, "high"), (threshold, "elevated"), (0.25, "mild")], "normal"), "anomalous": F.col("score") >= threshold})


def linear_contributions(df: DataFrame, weights: dict[str, float], key: Sequence[str], k: int = 3) -> DataFrame:
    """weight (x - mean) per feature with its percent share, the k largest per row."""
    means = df.agg(*(F.avg(c).alias(f"m_{c}") for c in weights))
    parts = F.array(*(F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.col(f"m_{c}"))).alias("part")) for c, w in weights.items()))
    rows = df.crossJoin(F.broadcast(means)).withColumn("parts", parts)
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + F.abs(x["part"]))
    told = F.transform("parts", lambda x: F.struct(-F.round(F.abs(x["part"]), 6).alias("by"), x["feature"].alias("feature"), F.round(x["part"], 4).alias("part"), F.round(F.when(F.col("total") > 0, 100 * F.abs(x["part"]) / F.col("total")).otherwise(0.0), 2).alias("share")))
    return rows.withColumn("total", total).select(*key, F.inline(F.slice(F.array_sort(told), 1, k))).select(*key, "feature", "part", "share")


#: Features that the rules read; one that a table lacks counts as missing.
FEATURES = ("hba1c", "fasting_glucose", "hemoglobin", "sex_female", "egfr", "creatinine", "alt", "ast", "ldl", "hdl", "tsh",
            "age", "missing_fraction", "risk_mean_proxy", "forecast_worsening_proxy", "trend_penalty")
#: Per condition the tests in order and the probability of the first that holds, else BASE_RISK.
BASE_RISK = 0.15
_CUT = "if(sex_female > 0 and sex_female < 0.5, 13, 12)"
RISK_RULES = {
    "type2_diabetes": (("hba1c >= 6.5", 0.82), ("hba1c >= 5.7", 0.55), ("fasting_glucose >= 126", 0.75), ("fasting_glucose >= 100", 0.45)),
    "anemia": ((f"hemoglobin < {_CUT} - 1", 0.78), (f"hemoglobin < {_CUT}", 0.5)),
    "ckd": (("egfr < 60", 0.8), ("creatinine > 1.3", 0.55)),
    "liver_dysfunction": (("alt > 55 or ast > 50", 0.72),),
    "thyroid_dysfunction": (("tsh > 4.5 or tsh < 0.3", 0.7),),
}
#: The score starts here; where a test holds, points are added.
START_SCORE = 88.0
SCORE_RULES = (
    ("hba1c >= 6.5", "-least(25, (hba1c - 5.7) * 8)"),
    ("hba1c >= 5.7 and hba1c < 6.5", "-(hba1c - 5.7) * 10"),
    ("fasting_glucose > 100", "-least(12, (fasting_glucose - 100) * 0.15)"),
    ("creatinine > 1.2", "-least(18, (creatinine - 1.2) * 15)"),
    ("egfr < 90", "-least(18, (90 - egfr) * 0.35)"),
    ("alt > 40", "-least(12, (alt - 40) * 0.15)"),
    ("ldl > 100", "-least(12, (ldl - 100) * 0.08)"),
    ("hdl < 40", "-least(10, (40 - hdl) * 0.5)"),
    ("hdl >= 60", "least(5, (hdl - 50) * 0.15)"),
    ("hemoglobin < 12", "-least(15, (12 - hemoglobin) * 3)"),
    ("tsh < 0.4 or tsh > 4.5", "-least(10, abs(tsh - 2.5) * 1.5)"),
    ("missing_fraction is not null", "-missing_fraction * 8"),
    ("risk_mean_proxy is not null", "-risk_mean_proxy * 15"),
    ("forecast_worsening_proxy is not null", "-forecast_worsening_proxy * 8"),
    ("trend_penalty is not null", "-trend_penalty * 0.3"),
    ("age > 60", "-least(5, (age - 60) * 0.15)"),
)


def _all_features(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({c: (F.col(c) if c in have else F.lit(None)).cast("double") for c in FEATURES})


def rule_risk(df: DataFrame, key: str, rules: dict[str, Sequence[tuple[str, float]]] = RISK_RULES) -> DataFrame:
    """One row per condition: the probability of its first rule that holds. Missing features fail their tests."""
    wide = _all_features(df)
    chain = {c: F.coalesce(*(F.when(F.expr(test), p) for test, p in tests), F.lit(BASE_RISK)) for c, tests in rules.items()}
    return wide.select(key, F.inline(F.array(*(F.struct(F.lit(c).alias("condition"), p.alias("probability")) for c, p in chain.items()))))


def heuristic_score(df: DataFrame, key: str) -> DataFrame:
    """A rule score from 5 to 99, higher is better."""
    points = (F.when(F.expr(test), F.expr(p)).otherwise(0.0) for test, p in SCORE_RULES)
    total = sum(points, F.lit(START_SCORE))
    return _all_features(df).select(key, F.round(F.greatest(F.lit(5.0), F.least(F.lit(99.0), total)), 4).alias("score"))
