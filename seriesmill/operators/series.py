"""Series operators: each works on all series of a table at once; a series is one key's rows in order of (time, id).

Summaries are grouped aggregates, so they combine before the shuffle; windows are used where rows must see neighbours.
Variances are population ones. Rows without a value are left out of numeric work and kept by selections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalar

KEYS = ("patient_id", "analyte")
DAY = 86400.0


def micros(t: str | Column = "ts") -> Column:
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def days(t: str | Column = "ts") -> Column:
    """Time as days since the epoch, in microsecond steps; the session's zone is UTC."""
    return micros(t) / F.lit(DAY * 1e6)


def ordered(keys: Sequence[str] = KEYS, t: str = "ts", i: str = "evidence_id") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(t, i)


def newest(keys: Sequence[str] = KEYS, t: str = "ts", i: str = "evidence_id") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(t).desc(), F.col(i).desc())


def whole(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def latest(df: DataFrame, keys: Sequence[str] = KEYS, t: str = "ts", i: str = "evidence_id") -> DataFrame:
    """The last row of each series, by aggregate: no window over the series."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(t, i)).alias("r")).select(*keys, "r.*")


def previous(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The row before last as primary and the last as reference; a single row stays as primary."""
    n = F.count(F.lit(1)).over(whole(keys))
    ranked = df.withColumn("rn", F.row_number().over(newest(keys))).withColumn("n", n).filter("rn <= 2")
    role = F.when((F.col("rn") == 2) | (F.col("n") == 1), "primary").otherwise("reference")
    return ranked.withColumn("role", role).drop("rn", "n")


def last_n(df: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last n rows, oldest first, with roles last_n_<i>_of_<m>."""
    ranked = df.withColumn("rn", F.row_number().over(newest(keys))).filter(F.col("rn") <= n)
    m = F.max("rn").over(whole(keys))
    return ranked.withColumn("role", F.format_string("last_n_%d_of_%d", m - F.col("rn") + 1, m)).drop("rn")


def first_abnormal(df: DataFrame, flag: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """The earliest abnormal row; without any, the latest row with role none_detected."""
    rest = [c for c in df.columns if c not in keys]
    row, at = F.struct(*rest), F.struct("ts", "evidence_id")
    hit = df.withColumn("bad", F.coalesce(flag, F.lit(False)))
    out = hit.groupBy(*keys).agg(
        F.min_by(F.when(F.col("bad"), row), F.when(F.col("bad"), at)).alias("first"), F.max_by(row, at).alias("last"), F.bool_or("bad").alias("any")
    )
    pick = out.withColumn("r", F.when(F.col("any"), F.col("first")).otherwise(F.col("last")))
    return pick.select(*keys, "r.*", F.when(F.col("any"), "first_abnormal").otherwise("none_detected").alias("role"))


def interval_roles(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """start, intermediate and end roles; a single row is a start."""
    rn, n = F.row_number().over(ordered(keys)), F.count(F.lit(1)).over(whole(keys))
    return df.withColumn("role", F.when(rn == 1, "start").when(rn == n, "end").otherwise("intermediate"))


def _ends(df: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Adds each series' first and last day and value, position and size."""
    full = ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.filter(F.col(v).isNotNull()).withColumn("d", days())
    df = df.withColumns({"d0": F.first("d").over(full), "v0": F.first(v).over(full), "d1": F.last("d").over(full), "v1": F.last(v).over(full)})
    return df.withColumns({"rn": F.row_number().over(ordered(keys)), "n": F.count(F.lit(1)).over(whole(keys))})


def chord_deviation(v: str = "value") -> Column:
    """Distance from the straight line between the first and the last point, at the point's own time."""
    line = F.when(F.col("d1") > F.col("d0"), F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0"))).otherwise(F.col("v0"))
    return F.abs(F.col(v) - line)


def inflection(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value", method: str = "chord") -> DataFrame:
    """The interior point farthest from the chord (or the baseline); ties to the earliest, then the least id. Series of
    fewer than three points have none."""
    dev = F.round(chord_deviation(v) if method == "chord" else F.abs(F.col(v) - F.col("v0")), 6)
    inner = _ends(df, keys, v).filter((F.col("rn") > 1) & (F.col("rn") < F.col("n"))).withColumn("deviation", dev)
    best = F.struct(-F.col("deviation"), F.col("ts"), F.col("evidence_id"))
    return inner.groupBy(*keys).agg(F.min_by(F.struct("evidence_id", "ts", v, "deviation"), best).alias("r")).select(*keys, "r.*")


def trend_anchors(df: DataFrame, most: int = 5, gap_days: float = 14.0, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """Baseline, endpoint and inflection, then milestones that lie at least ``gap_days`` from each of them, those farthest in
    time first, until the series has ``most`` rows. A lone row is a single_observation; two are baseline and endpoint."""
    ends = _ends(df, keys, v).withColumn("deviation", F.round(chord_deviation(v), 6))
    by = F.struct(-F.col("deviation"), F.col("ts"), F.col("evidence_id"))
    inner = (F.col("rn") > 1) & (F.col("rn") < F.col("n"))
    turn = F.min(F.when(inner & (F.col("deviation") > 0), by.withField("d", F.col("d")))).over(whole(keys))
    at = ends.withColumn("turn", turn)
    near = F.round(F.least(F.abs(F.col("d") - F.col("d0")), F.abs(F.col("d") - F.col("d1")), F.abs(F.col("d") - F.col("turn.d"))), 6)
    is_turn = F.coalesce(F.col("turn.evidence_id") == F.col("evidence_id"), F.lit(False)) & inner
    role = (
        F.when(F.col("n") == 1, "single_observation").when(F.col("rn") == 1, "baseline").when(F.col("rn") == F.col("n"), "endpoint")
        .when(is_turn, "inflection_point").when(near >= gap_days, "intermediate_milestone")
    )
    told = at.withColumns({"role": role, "near": near}).filter("role is not null")
    place = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.desc("near"), "ts", "evidence_id"))
    slots = most - 2 - F.col("turn").isNotNull().cast("int")
    kept = told.withColumn("place", place).filter((F.col("role") != "intermediate_milestone") | (F.col("place") <= slots))
    return kept.select(*keys, "evidence_id", "ts", v, "role")


def trajectory_features(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value", tolerance: float = 1e-4) -> DataFrame:
    """One row per series: rows, first and last time and span of all of them; of those with a value, the first and last value,
    extremes, change, change by the size of the first, change per day between the ends, direction, share of steps in that
    direction, signed share of rises less falls, and the row farthest from the chord. Steps and changes within ``tolerance``
    are flat. A single value is stable; without any the direction is insufficient_data. A column ``unit`` gives each series'
    first unit. One shuffle: windows and aggregate share their keys."""
    df = df.withColumns({"d": days(), "has": F.col(v).isNotNull()})
    run = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    full = ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = lambda f, c: f(F.when(F.col("has"), F.col(c)), ignorenulls=True).over(full)
    df = df.withColumns({
        "step": F.col(v) - F.last(v, ignorenulls=True).over(ordered(keys).rowsBetween(Window.unboundedPreceding, -1)), "k": F.count(v).over(run), "m": F.count(v).over(full),
        "d0": edge(F.first, "d"), "d1": edge(F.last, "d"), "v0": edge(F.first, v), "v1": edge(F.last, v),
    })
    inner = F.col("has") & (F.col("k") > 1) & (F.col("k") < F.col("m"))
    off = F.when(inner, F.round(chord_deviation(v), 6))
    at = F.struct("ts", "evidence_id")
    unit = [F.min_by("unit", F.when(F.col("unit").isNotNull(), at)).alias("unit")] if "unit" in df.columns else []
    agg = df.withColumn("off", off).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("m").alias("m"), F.max("d0").alias("d0"), F.max("d1").alias("d1"),
        F.max("v0").alias("baseline"), F.max("v1").alias("latest"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.count_if(F.col("step") > tolerance).alias("ups"), F.count_if(F.col("step") < -tolerance).alias("downs"),
        F.min_by("evidence_id", F.when(F.col("off") > 0, F.struct(-F.col("off"), F.col("ts"), F.col("evidence_id")))).alias("turn"), F.max("off").alias("off"), *unit,
    )
    one, none = F.col("m") == 1, F.col("m") == 0
    agg = agg.withColumn("delta", F.round(F.col("latest") - F.col("baseline"), 6)).withColumn("steps", F.col("m") - 1)
    relative = F.when(F.abs("baseline") > 1e-9, F.round(F.col("delta") / F.abs("baseline"), 6)).when(F.abs("latest") <= 1e-9, 0.0)
    slope = F.when(F.col("d1") > F.col("d0"), F.round(F.col("delta") / (F.col("d1") - F.col("d0")), 6)).when(~none, 0.0)
    direction = F.when(none, "insufficient_data").when(F.col("delta") > tolerance, "increasing").when(F.col("delta") < -tolerance, "decreasing").otherwise("stable")
    along = F.when(F.col("direction") == "increasing", F.col("ups")).when(F.col("direction") == "decreasing", F.col("downs")).otherwise(F.col("steps") - F.col("ups") - F.col("downs"))
    share = lambda c: F.when(none, 0.0).when(one, 1.0).otherwise(F.round(c / F.col("steps"), 4))
    net = F.when(F.col("ups") + F.col("downs") == 0, F.col("steps")).otherwise(F.col("ups") - F.col("downs"))
    span = F.round((micros("last_ts") - micros("first_ts")) / F.lit(DAY * 1e6), 2)
    return agg.withColumn("direction", direction).select(
        *keys, "n", "first_ts", "last_ts", span.alias("span_days"), "baseline", "latest", "low", "high", "delta", relative.alias("relative_change"), slope.alias("slope_per_day"), "direction",
        share(along).alias("consistency"), share(net).alias("monotonicity"), F.col("turn").alias("inflection_id"), F.coalesce("off", F.lit(0.0)).alias("inflection_deviation"), *(["unit"] if unit else []),
    )


def series_stats(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """last, mean, population deviation, slope per day (0 where all rows have one time), change from first to last, n."""
    df, at = df.filter(F.col(v).isNotNull()), F.struct("ts", "evidence_id")
    # time counts from the series' first row: of days since 1970, rows a few seconds apart keep half their digits
    start = df.groupBy(*(F.col(k).alias(f"{k}_") for k in keys)).agg(F.min("ts").alias("start_"))
    df = df.join(start, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).withColumn("d", (micros() - micros("start_")) / F.lit(DAY * 1e6))
    agg = df.groupBy(*keys).agg(
        F.max_by(v, at).alias("last"), F.min_by(v, at).alias("first"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.coalesce(F.regr_slope(v, "d"), F.lit(0.0)).alias("slope"), F.count(F.lit(1)).alias("n")
    )
    r = lambda c: F.round(c, 4).alias(c)
    return agg.select(*keys, r("last"), scalar.round_half("mean", 8).alias("mean"), scalar.round_half("std", 4).alias("std"), scalar.round_half("slope", 4).alias("slope"), F.round(F.col("last") - F.col("first"), 4).alias("delta"), "n")


def robust_z(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """(last - median) / (1.4826 MAD); where the MAD is 0, by the deviation; where that is 0 too, 0."""
    df = df.filter(F.col(v).isNotNull())
    mid = df.groupBy(*keys).agg(F.median(v).alias("mid"), F.max_by(v, F.struct("ts", "evidence_id")).alias("last"), F.stddev_pop(v).alias("std"), F.avg(v).alias("mean"))
    off = df.join(mid.select(*keys, "mid"), list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col(v) - F.col("mid"))).alias("mad"))
    z = F.when(F.col("mad") > 1e-9, (F.col("last") - F.col("mid")) / (1.4826 * F.col("mad"))).when(F.col("std") > 1e-9, (F.col("last") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return mid.join(off, list(keys)).select(*keys, F.round(z, 4).alias("robust_z"))


def zscore_trend(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value", steep: float = 0.25, limit: float = 2.0) -> DataFrame:
    """z of the last value against the whole series with its mean and deviation, how many of the last values in a row are
    farther than ``limit`` deviations, and the trend: slope per step in deviations above ``steep`` rises, below -``steep``
    falls. Fewer than three values are insufficient_data, without figures."""
    full = whole(keys)
    df = df.filter(F.col(v).isNotNull()).withColumns({"i": F.row_number().over(ordered(keys)).cast("double"), "mean": F.avg(v).over(full), "std": F.stddev_pop(v).over(full)})
    df = df.withColumn("z", F.when(F.col("std") > 0, (F.col(v) - F.col("mean")) / F.col("std")).otherwise(0.0))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("mean").alias("mean"), F.max("std").alias("std"), F.max_by("z", "i").alias("z"), F.regr_slope(v, "i").alias("slope"),
        F.max(F.when(F.abs(F.round("z", 9)) <= limit, F.col("i"))).alias("near"),
    )
    few = F.col("n") < 3
    s = F.round(F.when(F.col("std") > 0, F.col("slope") / F.col("std")).otherwise(0.0), 9)
    trend = F.when(few, "insufficient_data").when(s > steep, "rising").when(s < -steep, "falling").otherwise("stable")
    # by way of decimals: a mean of few values often ends on a 5
    told = lambda c, digits: F.when(~few, F.round(F.col(c).cast("decimal(28,9)"), digits).cast("double")).alias(c)
    streak = F.when(few, 0).otherwise(F.col("n") - F.coalesce("near", F.lit(0.0))).cast("long")
    return agg.select(*keys, "n", trend.alias("trend"), told("z", 3), told("mean", 4), told("std", 4), streak.alias("streak"))


def trailing_streak(df: DataFrame, limit: float = 2.0, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """How many of the last rows in a row are farther than ``limit`` deviations from the mean."""
    df = df.filter(F.col(v).isNotNull())
    full = whole(keys)
    z = (F.col(v) - F.avg(v).over(full)) / F.nullif(F.stddev_pop(v).over(full), F.lit(0.0))
    far = F.coalesce(F.abs(F.round(z, 6)) > limit, F.lit(False))
    ranked = df.withColumns({"far": far, "i": F.row_number().over(ordered(keys))})
    agg = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.col("far"), F.col("i"))).alias("last_near"))
    return agg.select(*keys, (F.col("n") - F.coalesce("last_near", F.lit(0))).alias("streak"))


def _past(keys: Sequence[str]) -> WindowSpec:
    return ordered(keys).rowsBetween(Window.unboundedPreceding, -1)


def causal_z(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value", digits: int = 4) -> DataFrame:
    """Each row's z against strictly earlier rows; null while there are fewer than two or they don't differ."""
    df, p = df.filter(F.col(v).isNotNull()), _past(keys)
    n, std = F.count(v).over(p), F.stddev_pop(v).over(p)
    z = F.when((n >= 2) & (std > 1e-9), (F.col(v) - F.avg(v).over(p)) / std)
    return df.select(*keys, "evidence_id", "ts", v, F.round(z, digits).alias("z"))


def pct_delta(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """Change against the row before, by its size (at least 1e-6)."""
    before = F.lag(v).over(ordered(keys))
    df = df.filter(F.col(v).isNotNull())
    return df.select(*keys, "evidence_id", F.round((F.col(v) - before) / F.greatest(F.abs(before), F.lit(1e-6)), 4).alias("pct_delta"))


def cusum(df: DataFrame, k: float = 0.5, h: float = 4.0, keys: Sequence[str] = KEYS, v: str = "value", digits: int = 4) -> DataFrame:
    """Two-sided tabular CUSUM of the series against the mean and deviation of all but the last value. As running sums:
    S(n) = T(n) - min(0, least T so far), so windows do it, whatever the series' length, and no array holds a series."""
    df = df.filter(F.col(v).isNotNull()).withColumn("rn", F.row_number().over(newest(keys)))
    past = F.col("rn") > 1
    full = whole(keys)
    mean, std = F.avg(F.when(past, F.col(v))).over(full), F.stddev_pop(F.when(past, F.col(v))).over(full)
    df = df.withColumns({"mean": mean, "std": std, "n": F.count(F.lit(1)).over(full)}).filter("n >= 3")
    unit = F.when(F.col("std") > 1e-9, (F.col(v) - F.col("mean")) / F.col("std")).otherwise(0.0)
    run = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"up": F.sum(unit - k).over(run), "down": F.sum(-unit - k).over(run)})
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(run))
    df = df.withColumns({"s_up": side("up"), "s_down": side("down")}).filter("rn = 1")
    size = F.round(F.greatest("s_up", "s_down"), digits)
    return df.select(*keys, F.round("s_up", 4).alias("s_up"), F.round("s_down", 4).alias("s_down"), size.alias("magnitude"), (size > h).alias("alarm"))


def monitor(df: DataFrame, z_limit: float = 2.0, step_limit: float = 0.25, k: float = 0.5, h: float = 4.0, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """The last value of each series against those before it: causal z, change against the value before by its size, and the
    two-sided CUSUM. Each may be a trigger; z or CUSUM raise the alarm, the change alone doesn't. The score runs from 1,
    nothing unusual, to -1 by the strongest of the three. Series of fewer than three values score 0. All windows of a series share one
    shuffle."""
    run, full = ordered(keys).rowsBetween(Window.unboundedPreceding, 0), whole(keys)
    df = df.filter(F.col(v).isNotNull()).withColumns({"rn": F.row_number().over(ordered(keys)), "n": F.count(F.lit(1)).over(full), "before": F.lag(v).over(ordered(keys))})
    past = F.when(F.col("rn") < F.col("n"), F.col(v))
    df = df.withColumns({"mean": F.avg(past).over(full), "std": F.stddev_pop(past).over(full)})
    df = df.withColumn("unit_z", F.when(F.col("std") > 1e-12, (F.col(v) - F.col("mean")) / F.col("std")).otherwise(0.0))
    df = df.withColumns({"up": F.sum(F.col("unit_z") - k).over(run), "down": F.sum(-F.col("unit_z") - k).over(run)})
    side = lambda c: F.col(c) - F.least(F.lit(0.0), F.min(c).over(run))
    df = df.withColumn("size", F.round(F.greatest(side("up"), side("down")), 9)).filter("rn = n")
    step = (F.col(v) - F.col("before")) / F.greatest(F.abs("before"), F.lit(1e-6))
    df = df.withColumns({"few": F.col("n") < 3, "z": F.round("unit_z", 9), "step": F.round(step, 9)})
    flat = F.col("std") <= 1e-12
    by_z, by_step, by_sum = F.abs("z") >= z_limit, F.abs("step") >= step_limit, ~flat & (F.col("size") > h)
    strength = F.greatest(F.least(F.abs("z") / 3, F.lit(1.0)), F.least(F.abs("step") / (2 * step_limit), F.lit(1.0)), F.when(flat, 0.0).otherwise(F.least(F.col("size") / h, F.lit(1.0))))
    triggers = F.concat_ws("+", F.when(by_z, F.lit("causal_z")), F.when(by_step, F.lit("pct_delta")), F.when(by_sum, F.lit("cusum")))
    unless = lambda c, short=None: F.when(F.col("few"), F.lit(short)).otherwise(c)
    return df.select(
        *keys, "n", unless(by_z | by_sum, False).alias("alarm"), unless(F.round(1 - 2 * strength, 4), 0.0).alias("score"), unless(F.lit("statistical_monitor"), "zscore_fallback").alias("method"),
        unless(F.round("z", 4)).alias("causal_z"), unless(F.round("step", 4)).alias("pct_delta"), unless(by_sum, False).alias("cusum_alarm"), unless(triggers, "").alias("triggers"),
    )


def detect(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value", low: float | None = None, high: float | None = None) -> DataFrame:
    """Trend and monitor side by side, with a sentence; outside the usual range ``low`` to ``high`` the sentence notes it, which
    raises no alarm."""
    both = zscore_trend(df, keys, v).join(monitor(df, keys=keys, v=v).drop("n"), list(keys))
    note = F.lit("")
    if low is not None and high is not None:
        both = both.join(latest(df.filter(F.col(v).isNotNull()), keys).select(*keys, F.col(v).alias("last_value")), list(keys))
        note = F.when((F.col("last_value") < low) | (F.col("last_value") > high), f", outside the range {low:g} to {high:g}").otherwise("")
    alarm = F.when(F.col("alarm"), F.concat(F.lit(", alarm by "), "triggers")).otherwise("")
    text = F.concat(F.format_string("%s: %s after %d values", F.col(keys[-1]), F.col("trend"), F.col("n")), alarm, note)
    return both.select(*keys, "trend", "z", "streak", "alarm", "score", text.alias("summary"))


def lag_features(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """For every prefix of each series: last three values, mean and deviation of three, mean of all, change, slope per day
    from running sums, span and n."""
    df = df.filter(F.col(v).isNotNull())
    w, run, three = ordered(keys), ordered(keys).rowsBetween(Window.unboundedPreceding, 0), ordered(keys).rowsBetween(-2, 0)
    first = F.first("ts").over(run)
    df = df.withColumn("x", (micros("ts") - micros(first)) / F.lit(DAY * 1e6))
    s = {"n": F.count(F.lit(1)).over(run), "sx": F.sum("x").over(run), "sy": F.sum(v).over(run), "sxy": F.sum(F.col("x") * F.col(v)).over(run), "sxx": F.sum(F.col("x") * F.col("x")).over(run)}
    lags = {f"lag{i}": F.lag(v, i).over(w) for i in (1, 2, 3)}
    df = df.withColumns(s | lags | {"mean3": F.avg(v).over(three), "std3": F.stddev_pop(v).over(three), "next_value": F.lead(v).over(w), "next_ts": F.lead("ts").over(w)})
    below = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(below > 1e-9, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / below).otherwise(0.0)
    return df.select(*keys, "evidence_id", "ts", v, "lag1", "lag2", "lag3", F.round("mean3", 4).alias("mean3"), F.round("std3", 4).alias("std3"), F.round(F.col("sy") / F.col("n"), 4).alias("mean_all"), F.round(F.col(v) - F.col("lag1"), 4).alias("delta"), F.round(slope, 3).alias("slope"), F.round("x", 4).alias("span"), "n", "next_value", "next_ts")


def supervised_rows(df: DataFrame, min_points: int = 3, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """Prefix features with the next value as target, where it is at least a day later and the prefix is long enough."""
    rows = lag_features(df, keys, v).filter((F.col("n") >= min_points) & F.col("next_value").isNotNull())
    gap = (micros("next_ts") - micros("ts")) / F.lit(DAY * 1e6)
    return rows.withColumn("gap_days", F.round(gap, 4)).filter("gap_days >= 1").drop("next_ts")


def redundancy_rate(df: DataFrame, near_days: float = 14.0, near_share: float = 0.05, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """Share of neighbouring rows of each series that lie close in time and value."""
    w = ordered(keys)
    df = df.filter(F.col(v).isNotNull()).withColumns({"pv": F.lag(v).over(w), "pd": F.lag(days()).over(w)})
    close = (days() - F.col("pd") <= near_days) & (F.abs(F.col(v) - F.col("pv")) <= near_share * F.greatest(F.abs("pv"), F.lit(1e-9)))
    return df.groupBy(*keys).agg(F.count_if(close).alias("redundant"), F.round(F.coalesce(F.count_if(close) / F.nullif(F.count("pv"), F.lit(0)), F.lit(0.0)), 4).alias("rate"))


def trajectory_roles(df: DataFrame, keys: Sequence[str] = KEYS, v: str = "value") -> DataFrame:
    """Role and weight of each point for reranking: baseline and endpoint 0.9, inflection 1.0, others 0.5."""
    turn = inflection(df, keys, v).select(*keys, F.col("evidence_id").alias("turn_id"))
    at = _ends(df, keys, v).join(turn, list(keys), "left")
    role = F.when(F.col("rn") == 1, "baseline").when(F.col("rn") == F.col("n"), "endpoint").when(F.col("evidence_id") == F.col("turn_id"), "inflection").otherwise("intermediate")
    at = at.withColumn("role", role)
    score = F.when(F.col("role") == "inflection", 1.0).when(F.col("role").isin("baseline", "endpoint"), 0.9).otherwise(0.5)
    return at.select(*keys, "evidence_id", "role", score.alias("role_score"))


def temporal_score(df: DataFrame, operator: str, keys: Sequence[str] = KEYS, n: int = 3, start: str | None = None, end: str | None = None) -> DataFrame:
    """How well a row's time fits an operator: latest 1/(1 + 2 d) by rank d, last_n max(0.8, 1 - 0.05 r) within n and 0.1 for older rows, previous
    1 for the row before last and 0.5 for the last (a lone row 1), window 1 inside, trend 1, any other 0.5."""
    d = F.row_number().over(newest(keys)) - 1
    day = F.to_date("ts")
    inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date")) if start else F.lit(True)
    score = {
        "latest": 1.0 / (1.0 + 2.0 * d),
        "last_n": F.when(d < n, F.greatest(F.lit(0.8), 1.0 - 0.05 * d)).otherwise(0.1),
        "previous": F.when((d == 1) | (F.count(F.lit(1)).over(whole(keys)) == 1), 1.0).when(d == 0, 0.5).otherwise(0.0),
        "window": F.when(inside, 1.0).otherwise(0.0),
        "trend": F.lit(1.0),
    }.get(operator, F.lit(0.5))
    return df.select(*keys, "evidence_id", F.round(score, 6).alias("s_temporal"))


def revision_history(rows: DataFrame, revisions: DataFrame, key: str, t: str) -> DataFrame:
    """Old versions in order of time, the current row last."""
    both = revisions.withColumn("current", F.lit(False)).unionByName(rows.withColumn("current", F.lit(True)))
    return both.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy("current", t)))


def latest_version(rows: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """Each key's highest version, and the stale rows that lost."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    ranked = rows.withColumn("place", F.row_number().over(w))
    return ranked.filter("place = 1").drop("place"), ranked.filter("place > 1").drop("place")
