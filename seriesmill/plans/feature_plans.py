"""The query of the feature table, with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql):
    _add_there(name, run, sql)
    QUERIES[name], ORACLE[name] = _Q.pop(name), _O.pop(name)


#: Event types as labs, and what brings their values into the labs' range.
_LABS = {"click": ("hba1c", 30.0), "purchase": ("creatinine", 150.0), "error": ("alt", 2.0), "signup": ("ast", 2.0), "view": ("hemoglobin", 10.0)}


def _metrics(t):
    kind = lambda k: F.coalesce(*(F.when(F.col("analyte") == e, F.lit(v[k])) for e, v in _LABS.items()))
    return t.events().select("patient_id", kind(0).alias("analyte"), "ts", (F.col("value") / kind(1)).alias("value"), "evidence_id")


def _people(t):
    sex = F.when(F.col("c_nationkey") % 3 == 0, " Female").when(F.col("c_nationkey") % 3 == 1, "M")
    return t("customer").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 80 + 10).alias("age"), sex.alias("sex"))


_last = lambda n: next((f"arg_max(value / {d}, (ts, evidence_id)) filter (where analyte = '{e}' and value is not null)" for e, (lab, d) in _LABS.items() if lab == n), "null::double")
_own = {lab: (e, d) for e, (lab, d) in _LABS.items()}
_half = lambda c, n: f"round(({c})::decimal(38, 10), {n})::double"
_fit = lambda n: _half("coalesce(nullif(regr_slope(value / {1}, datediff('day', date '1970-01-01', ts::date) - 20000.0::double) filter (where analyte = '{0}'), 'nan'::double), 0)", 8).format(*_own[n])
_clamp = lambda c: f"least(1.0, greatest(0.0, {c}))"
_RISKS = ", ".join(
    f"case when {n} is not null then {_clamp(c)} end"
    for n, c in (("hba1c", "(hba1c - 5.4) / 4.0"), ("creatinine", "(creatinine - 0.9) / 2.0"), ("alt", "(alt - 40) / 120.0"), ("hemoglobin", "(13.5 - hemoglobin) / 5.0"))
)
_add("m1_feature_table", lambda t: features.feature_table(_metrics(t), _people(t)), f"""@events,
  w as (select patient_id, {", ".join(f"{_last(n)} as {n}" for n in (*features.CORE, "total_cholesterol"))}, {", ".join(f"{_fit(n)} as {n}_slope" for n in features.SLOPES)} from o group by 1),
  k as (select w.*, (c_custkey % 80 + 10)::double as age, case when c_nationkey % 3 = 0 then 1.0 when c_nationkey % 3 = 1 then 0.0 else 0.5 end::double as sex_female,
      list_filter([{_RISKS}], lambda x: x is not null) as risks, (hba1c is not null)::int + (creatinine is not null)::int + (alt is not null)::int + (ast is not null)::int + (hemoglobin is not null)::int as present,
      greatest(0.0, hba1c_slope) + greatest(0.0, creatinine_slope) + greatest(0.0, alt_slope) + greatest(0.0, -hemoglobin_slope) as up
    from w left join customer on c_custkey = patient_id)
  select patient_id, age, sex_female, {", ".join((*features.CORE, "total_cholesterol"))}, {", ".join(f"{n}_slope" for n in features.SLOPES)},
    case when alt > 0 then {_half('ast / alt', 6)} end as ast_alt_ratio, null::double as tc_hdl_ratio, null::double as non_hdl, present::double as n_recent_labs, {_half('1 - present / 11.0::double', 6)} as missing_fraction,
    case when len(risks) = 0 then 0.35 else {_half('list_sum(risks) / len(risks)', 6)} end::double as risk_mean_proxy, case when len(risks) = 0 then 0.35 else {_half('list_max(risks)', 6)} end::double as risk_max_proxy,
    {_half('least(1.0, up * 50)', 6)} as forecast_worsening_proxy, {_half('least(20.0, up * 200)', 6)} as trend_penalty from k""")
