"""Queries of the series operators with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import SQL_EVENTS, SQL_ORDERS, obs_events, obs_orders
from ..operators import series

QUERIES: dict = {}
ORACLE: dict = {}
_BY = "partition by patient_id, analyte order by ts, evidence_id"
_DOWN = "partition by patient_id, analyte order by ts desc, evidence_id desc"
_DAY = "epoch_us(ts) / 86400e6"


def _add(name, run, sql, source=obs_events):
    QUERIES[name] = lambda spark, sf_dir: run(source(spark, sf_dir))
    with_ = SQL_EVENTS if source is obs_events else SQL_ORDERS
    ORACLE[name] = f"with {with_}{', ' if sql.lstrip().startswith('@') else ' '}{sql.lstrip().removeprefix('@')}"


_add("w2_latest", series.latest, f"select * exclude rn from (select *, row_number() over ({_DOWN}) rn from o) where rn = 1")
_add("w3_previous", series.previous, f"""select patient_id, analyte, ts, value, evidence_id, case when rn = 2 or n = 1 then 'primary' else 'reference' end as role
  from (select *, row_number() over ({_DOWN}) rn, count(*) over (partition by patient_id, analyte) n from o) where rn <= 2""")
_add("w4_last_n", lambda d: series.last_n(d, 5), f"""@l as (select *, row_number() over ({_DOWN}) rn from o)
  select patient_id, analyte, ts, value, evidence_id, 'last_n_' || (m - rn + 1) || '_of_' || m as role
  from (select *, max(rn) over (partition by patient_id, analyte) m from l where rn <= 5)""")
_add("w5_first_abnormal", lambda d: series.first_abnormal(d, F.col("value") > 200), """@f as (select patient_id, analyte,
    min((ts, evidence_id)) filter (where value > 200) as bad, max((ts, evidence_id)) as newest from o group by 1, 2)
  select o.*, case when bad is null then 'none_detected' else 'first_abnormal' end as role
  from o join f using (patient_id, analyte) where (o.ts, o.evidence_id) = coalesce(bad, newest)""")
_add("w6_interval_roles", series.interval_roles, f"""select patient_id, analyte, ts, value, evidence_id,
    case when rn = 1 then 'start' when rn = n then 'end' else 'intermediate' end as role
  from (select *, row_number() over ({_BY}) rn, count(*) over (partition by patient_id, analyte) n from o)""", obs_orders)

_ENDS = f"""@e as (select *, {_DAY} as d, first_value({_DAY}) over w as d0, first_value(value) over w as v0, last_value({_DAY}) over w as d1, last_value(value) over w as v1,
    row_number() over ({_BY}) as rn, count(*) over (partition by patient_id, analyte) as n
    from o where value is not null window w as ({_BY} rows between unbounded preceding and unbounded following)),
  c as (select *, round(abs(value - case when d1 > d0 then v0 + (v1 - v0) * (d - d0) / (d1 - d0) else v0 end), 6) as deviation from e),
  t as (select patient_id, analyte, evidence_id, ts, value, deviation, d from c where rn > 1 and rn < n
    qualify row_number() over (partition by patient_id, analyte order by deviation desc, ts, evidence_id) = 1)"""
_add("w7_inflection", series.inflection, _ENDS + " select patient_id, analyte, evidence_id, ts, value, deviation from t")
_add("w8_trend_anchors", series.trend_anchors, _ENDS + """, i as (select patient_id, analyte, evidence_id, d from t where deviation > 0),
  r as (select c.*, i.d as turn, round(least(abs(c.d - d0), abs(c.d - d1), abs(c.d - i.d)), 6) as near,
      case when n = 1 then 'single_observation' when rn = 1 then 'baseline' when rn = n then 'endpoint' when c.evidence_id = i.evidence_id then 'inflection_point'
      when round(least(abs(c.d - d0), abs(c.d - d1), abs(c.d - i.d)), 6) >= 14 then 'intermediate_milestone' end as role from c left join i using (patient_id, analyte)),
  p as (select *, row_number() over (partition by patient_id, analyte, role order by near desc, ts, evidence_id) as place from r where role is not null)
  select patient_id, analyte, evidence_id, ts, value, role from p where role <> 'intermediate_milestone' or place <= case when turn is null then 3 else 2 end""")
_add("w22_trajectory_roles", series.trajectory_roles, _ENDS + """, r as (select c.patient_id, c.analyte, c.evidence_id,
      case when rn = 1 then 'baseline' when rn = n then 'endpoint' when c.evidence_id = t.evidence_id then 'inflection' else 'intermediate' end as role
      from c left join t using (patient_id, analyte))
  select *, case role when 'inflection' then 1.0::double when 'intermediate' then 0.5::double else 0.9::double end as role_score from r""")
_add("a5_trajectory_features", series.trajectory_features, _ENDS + f""", every as (select patient_id, analyte, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from o group by 1, 2),
  s as (select *, value - lag(value) over ({_BY}) as step from c),
  g as (select patient_id, analyte, count(*) as m, min(d0) as d0, min(d1) as d1, min(v0) as baseline, min(v1) as latest, min(value) as low, max(value) as high,
    count(*) filter (where step > 1e-4) as ups, count(*) filter (where step < -1e-4) as downs from s group by 1, 2),
  h as (select *, round(latest - baseline, 6) as delta, m - 1 as steps from every left join g using (patient_id, analyte)),
  k as (select *, case when m is null then 'insufficient_data' when delta > 1e-4 then 'increasing' when delta < -1e-4 then 'decreasing' else 'stable' end as direction from h)
  select patient_id, analyte, n, first_ts, last_ts, round((epoch_us(last_ts) - epoch_us(first_ts)) / 86400e6, 2) as span_days, baseline, latest, low, high, delta,
    case when abs(baseline) > 1e-9 then round(delta / abs(baseline), 6) when abs(latest) <= 1e-9 then 0 end as relative_change,
    case when d1 > d0 then round(delta / (d1 - d0), 6) when m is not null then 0 end as slope_per_day, direction,
    case when m is null then 0.0 when m = 1 then 1.0 else round(case direction when 'increasing' then ups when 'decreasing' then downs else steps - ups - downs end / steps::double, 4) end as consistency,
    case when m is null then 0.0 when m = 1 then 1.0 else round(case when ups + downs = 0 then steps else ups - downs end / steps::double, 4) end as monotonicity,
    case when t.deviation > 0 then t.evidence_id end as inflection_id, coalesce(t.deviation, 0) as inflection_deviation
  from k left join t using (patient_id, analyte)""")
_add("a6_series_stats", series.series_stats, """select patient_id, analyte, round(arg_max(value, (ts, evidence_id)), 4) as last, round(avg(value)::decimal(38, 10), 8)::double as mean, round(stddev_pop(value)::decimal(38, 10), 4)::double as std,
    round(coalesce(nullif(regr_slope(value, age / 86400e6), 'nan'::double), 0)::decimal(38, 10), 4)::double as slope, round(arg_max(value, (ts, evidence_id)) - arg_min(value, (ts, evidence_id)), 4) as delta, count(*) as n from (select *, epoch_us(ts) - epoch_us(min(ts) over (partition by patient_id, analyte)) as age from o where value is not null) group by 1, 2""")
_add("a8_robust_z", series.robust_z, """@m as (select patient_id, analyte, median(value) as mid, arg_max(value, (ts, evidence_id)) as last, stddev_pop(value) as std, avg(value) as mean from o where value is not null group by 1, 2),
  a as (select patient_id, analyte, median(abs(value - mid)) as mad from o join m using (patient_id, analyte) where value is not null group by 1, 2)
  select patient_id, analyte, round(case when mad > 1e-9 then (last - mid) / (1.4826 * mad) when std > 1e-9 then (last - mean) / std else 0 end, 4) as robust_z from m join a using (patient_id, analyte)""")
_T = f"""zs as (select *, row_number() over ({_BY})::double as i, avg(value) over w as mean, stddev_pop(value) over w as std,
    case when stddev_pop(value) over w > 0 then (value - avg(value) over w) / stddev_pop(value) over w else 0 end as z from o where value is not null window w as (partition by patient_id, analyte)),
  zg as (select patient_id, analyte, count(*) as n, max(mean) as mean, max(std) as std, arg_max(z, i) as z, regr_slope(value, i) as slope, max(i) filter (where abs(round(z, 9)) <= 2) as near from zs group by 1, 2),
  zh as (select *, round(case when std > 0 then slope / std else 0 end, 9) as s from zg),
  zt as (select patient_id, analyte, n, case when n < 3 then 'insufficient_data' when s > 0.25 then 'rising' when s < -0.25 then 'falling' else 'stable' end as trend,
    case when n >= 3 then round(z::decimal(28, 9), 3)::double end as z, case when n >= 3 then round(mean::decimal(28, 9), 4)::double end as mean, case when n >= 3 then round(std::decimal(28, 9), 4)::double end as std,
    case when n < 3 then 0 else n - coalesce(near, 0)::bigint end as streak from zh)"""
_add("w11_zscore_trend", series.zscore_trend, f"@{_T} select * from zt")
_add("w12_trailing_streak", lambda d: series.trailing_streak(d, 1.0), f"""@z as (select *, coalesce(abs(round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6)) > 1, false) as far, row_number() over ({_BY}) as i
    from o where value is not null window w as (partition by patient_id, analyte))
  select patient_id, analyte, count(*) - coalesce(max(i) filter (where not far), 0) as streak from z group by 1, 2""")
_Z = f"""z as (select *, case when count(value) over p >= 2 and stddev_pop(value) over p > 1e-9 then round((value - avg(value) over p) / stddev_pop(value) over p, 4) end as z
    from o where value is not null window p as ({_BY} rows between unbounded preceding and 1 preceding))"""
_add("w13_causal_z", series.causal_z, f"@{_Z} select patient_id, analyte, evidence_id, ts, value, z from z")
_add("w14_pct_delta", series.pct_delta, f"""select patient_id, analyte, evidence_id, round((value - lag(value) over w) / greatest(abs(lag(value) over w), 1e-6), 4) as pct_delta
  from o where value is not null window w as ({_BY})""")
_C = f"""b as (select *, row_number() over ({_DOWN}) as rn, count(*) over (partition by patient_id, analyte) as n from o where value is not null),
  m as (select patient_id, analyte, avg(value) as mean, stddev_pop(value) as std from b where rn > 1 group by 1, 2),
  u as (select b.*, case when std > 1e-9 then (value - mean) / std else 0 end as x from b join m using (patient_id, analyte) where n >= 3),
  r as (select *, sum(x - 0.5) over w as up, sum(-x - 0.5) over w as down from u window w as ({_BY} rows between unbounded preceding and current row)),
  k as (select patient_id, analyte, rn, up - least(0, min(up) over w) as s_up, down - least(0, min(down) over w) as s_down from r window w as ({_BY} rows between unbounded preceding and current row)),
  cu as (select patient_id, analyte, round(s_up, 4) as s_up, round(s_down, 4) as s_down, round(greatest(s_up, s_down), 4) as magnitude, round(greatest(s_up, s_down), 4) > 4 as alarm from k where rn = 1)"""
_add("w15_cusum", series.cusum, f"@{_C} select * from cu")
_M = f"""mb as (select *, row_number() over ({_BY}) as rn, count(*) over (partition by patient_id, analyte) as n, lag(value) over ({_BY}) as before from o where value is not null),
  mp as (select patient_id, analyte, avg(value) as mean, stddev_pop(value) as std from mb where rn < n group by 1, 2),
  mu as (select mb.*, std, case when std > 1e-12 then (value - mean) / std else 0 end as u from mb left join mp using (patient_id, analyte)),
  mr as (select *, sum(u - 0.5) over w as up, sum(-u - 0.5) over w as down from mu window w as ({_BY} rows between unbounded preceding and current row)),
  mk as (select *, round(greatest(up - least(0, min(up) over w), down - least(0, min(down) over w)), 9) as size from mr window w as ({_BY} rows between unbounded preceding and current row)),
  ml as (select *, round(u, 9) as z, round((value - before) / greatest(abs(before), 1e-6), 9) as step, coalesce(std > 1e-12, false) as varies from mk where rn = n),
  mm as (select patient_id, analyte, n, n >= 3 and (abs(z) >= 2 or varies and size > 4) as alarm,
    case when n < 3 then 0 else round(1 - 2 * greatest(least(abs(z) / 3, 1), least(abs(step) / 0.5, 1), case when varies then least(size / 4, 1) else 0 end), 4) end as score,
    case when n < 3 then 'zscore_fallback' else 'statistical_monitor' end as method, case when n >= 3 then round(z, 4) end as causal_z, case when n >= 3 then round(step, 4) end as pct_delta,
    n >= 3 and varies and size > 4 as cusum_alarm,
    case when n < 3 then '' else concat_ws('+', case when abs(z) >= 2 then 'causal_z' end, case when abs(step) >= 0.25 then 'pct_delta' end, case when varies and size > 4 then 'cusum' end) end as triggers from ml)"""
_add("w16_monitor", series.monitor, f"@{_M} select * from mm")
_add("w17_detect", lambda d: series.detect(d, low=50.0, high=150.0), f"""@{_M}, {_T}, la as (select patient_id, analyte, arg_max(value, (ts, evidence_id)) as last_value from o where value is not null group by 1, 2)
  select patient_id, analyte, trend, z, streak, alarm, score, analyte || ': ' || trend || ' after ' || zt.n || ' values' || case when alarm then ', alarm by ' || triggers else '' end
    || case when last_value < 50 or last_value > 150 then ', outside the range 50 to 150' else '' end as summary
  from zt join mm using (patient_id, analyte) join la using (patient_id, analyte)""")
_L = f"""x as (select *, (epoch_us(ts) - epoch_us(first_value(ts) over (w rows between unbounded preceding and current row))) / 86400e6 as x from o where value is not null window w as ({_BY})),
  p as (select *, count(*) over r as n, sum(x) over r as sx, sum(value) over r as sy, sum(x * value) over r as sxy, sum(x * x) over r as sxx, lag(value, 1) over w as lag1, lag(value, 2) over w as lag2, lag(value, 3) over w as lag3,
    round(avg(value) over t, 4) as mean3, round(stddev_pop(value) over t, 4) as std3, lead(value) over w as next_value, lead(ts) over w as next_ts
    from x window w as ({_BY}), r as ({_BY} rows between unbounded preceding and current row), t as ({_BY} rows between 2 preceding and current row)),
  l as (select patient_id, analyte, evidence_id, ts, value, lag1, lag2, lag3, mean3, std3, round(sy / n, 4) as mean_all, round(value - lag1, 4) as delta,
    round(case when n * sxx - sx * sx > 1e-9 then (n * sxy - sx * sy) / (n * sxx - sx * sx) else 0 end, 3) as slope, round(x, 4) as span, n, next_value, next_ts from p)"""
_add("w18_lag_features", series.lag_features, f"@{_L} select * from l", obs_orders)
_add("w19_supervised_rows", series.supervised_rows, f"@{_L} select * exclude next_ts, round((epoch_us(next_ts) - epoch_us(ts)) / 86400e6, 4) as gap_days from l where n >= 3 and next_value is not null and round((epoch_us(next_ts) - epoch_us(ts)) / 86400e6, 4) >= 1", obs_orders)
_add("w20_redundancy_rate", series.redundancy_rate, f"""@g as (select *, lag(value) over w as pv, {_DAY} - lag({_DAY}) over w as gap from o where value is not null window w as ({_BY}))
  select patient_id, analyte, count(*) filter (where gap <= 14 and abs(value - pv) <= 0.05 * greatest(abs(pv), 1e-9)) as redundant,
    round(coalesce(count(*) filter (where gap <= 14 and abs(value - pv) <= 0.05 * greatest(abs(pv), 1e-9)) / nullif(count(pv), 0)::double, 0), 4) as rate from g group by 1, 2""")
_D = f"d as (select *, row_number() over ({_DOWN}) - 1 as d, count(*) over (partition by patient_id, analyte) as m from o)"
for _op, _expr in (("latest", "1 / (1 + 2.0 * d)"), ("last_n", "case when d < 3 then greatest(0.8, 1 - 0.05 * d) else 0.1 end"), ("previous", "case when d = 1 or m = 1 then 1.0 when d = 0 then 0.5 else 0 end")):
    _add(f"w21_temporal_score_{_op}", lambda x, op=_op: series.temporal_score(x, op), f"@{_D} select patient_id, analyte, evidence_id, round(({_expr})::double, 6) as s_temporal from d")
_add("w21_temporal_score_window", lambda x: series.temporal_score(x, "window", start="1995-01-01", end="1996-12-31"), "select patient_id, analyte, evidence_id, case when ts::date between date '1995-01-01' and date '1996-12-31' then 1.0 else 0.0 end::double as s_temporal from o", obs_orders)
def latest_of(d):
    """The current row of each patient: the one with the highest id."""
    return series.latest_version(d, "patient_id", "evidence_id")[0]


def _history(d):
    now = latest_of(d)
    old = series.latest_version(d, "patient_id", "evidence_id")[1]
    return series.revision_history(now, old, "patient_id", "evidence_id").select("patient_id", "evidence_id", "current", "version")


_add("w23_revision_history", _history, """@n as (select patient_id, max(evidence_id) as m from o group by 1)
  select patient_id, evidence_id, evidence_id = m as current, row_number() over (partition by patient_id order by evidence_id = m, evidence_id) as version from o join n using (patient_id)""", obs_orders)
def _stale(d):
    now, old = series.latest_version(d, "patient_id", "evidence_id")
    both = now.withColumn("stale", F.lit(False)).unionByName(old.withColumn("stale", F.lit(True)))
    return both.groupBy("patient_id").agg(F.max("evidence_id").alias("current_id"), F.count_if("stale").alias("n_stale"))


_add("w24_latest_version", _stale,
     "select patient_id, max(evidence_id) as current_id, count(*) - 1 as n_stale from o group by 1", obs_orders)
