"""Queries of questions read from text and of evidence by intent, over the tables' own rows, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import SQL_EVENTS
from ..operators import claims, hybrid, questions, retrieval, selection, series
from ..session import scratch
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there
from .series_plans import _BY, _DOWN, _ENDS
from .series_plans import ORACLE as _SERIES

_W22 = _SERIES["w22_trajectory_roles"]

QUERIES: dict = {}
ORACLE: dict = {}

#: One question per series, its kind by its first row's number.
_INTENTS = ["LAST_N", "DATE_COMPARISON", "PREVIOUS_VALUE", "CURRENT_VALUE", "ABNORMALITY", "HISTORICAL_VALUE", "LONGITUDINAL_TREND", "UNKNOWN"]
_ASKED = ["show the results", "when did it first go up", "the trend over time", "is it out of range", "compare 2024-01-01 with 2024-02-01"]


def _add(name, run, sql):
    _add_there(name, run, sql)
    QUERIES[name], ORACLE[name] = _Q.pop(name), _O.pop(name)


def _questions(t):
    """Four questions for each series, of which the tables' rows choose kind and words."""
    own = t.events().groupBy("patient_id", "analyte").agg(F.min("evidence_id").alias("first_id"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    each = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("query_id", F.col("first_id") * 4 + F.col("k"))
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    dated = F.col("query_id") % 3 == 0
    return each.select(
        "query_id", "patient_id", "analyte", pick(_ASKED, F.col("query_id")).alias("raw_query"), pick(_INTENTS, F.floor(F.col("query_id") / 5)).alias("intent"),
        F.when(F.col("query_id") % 11 == 0, "BETWEEN").alias("operator"), F.when(F.col("query_id") % 13 == 0, F.lit(4)).alias("wanted"), F.lit(None).cast("string").alias("against"),
        (F.col("query_id") % 17 == 0).alias("abnormal_only"), F.when(dated, F.col("start_ts")).alias("start_ts"), F.when(dated, F.col("end_ts")).alias("end_ts"),
    )


_list = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_SQL = _ENDS.removeprefix("@") + f""",
  own as (select patient_id, analyte, min(evidence_id) as first_id, min(ts) as s, max(ts) as e from o group by 1, 2),
  q as (select patient_id, analyte, first_id * 4 + k as query_id, s, e from own, range(4) as r(k)),
  typed as (select *, {_list(_ASKED)}[query_id % 5 + 1] as raw, {_list(_INTENTS)}[(query_id // 5) % 8 + 1] as intent, query_id % 3 = 0 as dated from q),
  modes as (select *, case when intent = 'LAST_N' or query_id % 13 = 0 then 'last_n'
      when intent = 'DATE_COMPARISON' or raw like 'compare%' then 'dates'
      when intent = 'PREVIOUS_VALUE' and raw not like '%trend%' then 'previous'
      when intent = 'CURRENT_VALUE' and raw not like '%trend%' then 'current'
      when intent = 'ABNORMALITY' or query_id % 17 = 0 or raw like '%out of range%' or regexp_matches(raw, 'high|low|elevated|flagged') then case when raw like 'when did%' then 'first_abnormal' else 'abnormal' end
      when intent = 'HISTORICAL_VALUE' or query_id % 11 = 0 then 'interval' else 'trend' end as mode from typed),
  ranked as (select *, row_number() over ({_BY}) as rn, row_number() over ({_DOWN}) as back, count(*) over (partition by patient_id, analyte) as n,
      count(*) filter (where value > 200) over (partition by patient_id, analyte) as bads,
      count(*) filter (where value > 200) over ({_BY} rows between unbounded preceding and current row) as nth from o),
  placed as (select m.query_id, m.mode, m.dated, case when query_id % 13 = 0 then 4 else 3 end as wanted, ranked.* from modes m join ranked using (patient_id, analyte)),
  -- the questions' times are the series' ends, so the nearest rows are the first of each end's ties
  near as (select patient_id, analyte, min(evidence_id) filter (where ts = s) as a, min(evidence_id) filter (where ts = e) as b from o join own using (patient_id, analyte) group by 1, 2),
  stepwise as (select query_id, mode, evidence_id, ts, value, case mode
      when 'last_n' then case when back <= wanted then 'last_n_' || (least(wanted, n) - back + 1) || '_of_' || least(wanted, n) end
      when 'dates' then case when n <= 2 then 'comparison_anchor' when dated and evidence_id = a then 'comparison_date_a' when dated and evidence_id = b then 'comparison_date_b'
        when not dated and rn = 1 then 'comparison_baseline' when not dated and back = 1 then 'comparison_endpoint' end
      when 'previous' then case when n = 1 then 'only_observation_available' when back = 1 then 'reference_latest' when back = 2 then 'predecessor' end
      when 'current' then case when back = 1 then 'latest' end
      when 'first_abnormal' then case when value > 200 and nth = 1 then 'first_abnormal' when bads = 0 and back = 1 then 'no_abnormality_detected' end
      when 'abnormal' then case when value > 200 then 'abnormal' when bads = 0 and back = 1 then 'no_abnormality_detected' end
      when 'interval' then case when rn = 1 then 'interval_start' when back = 1 then 'interval_end' else 'interval_intermediate' end end as role
    from placed join near using (patient_id, analyte)),
  i as (select patient_id, analyte, evidence_id, d from t where deviation > 0),
  r as (select c.*, i.d as turn, round(least(abs(c.d - d0), abs(c.d - d1), abs(c.d - i.d)), 6) as near,
      case when n = 1 then 'single_observation' when rn = 1 then 'baseline' when rn = n then 'endpoint' when c.evidence_id = i.evidence_id then 'inflection_point'
      when round(least(abs(c.d - d0), abs(c.d - d1), abs(c.d - i.d)), 6) >= 14 then 'intermediate_milestone' end as role from c left join i using (patient_id, analyte)),
  p as (select *, row_number() over (partition by patient_id, analyte, role order by near desc, ts, evidence_id) as place from r where role is not null),
  every as (select * from stepwise where role is not null union all
    select query_id, mode, evidence_id, ts, value, role from modes join p using (patient_id, analyte)
    where mode = 'trend' and (role <> 'intermediate_milestone' or place <= case when turn is null then 8 else 7 end))
  select *, role not in ('reference_latest', 'no_abnormality_detected', 'intermediate_milestone') as is_primary from every"""
_add("x23_select_evidence", lambda t: selection.select_evidence(_questions(t), t.events(), F.col("value") > 200), "@events, " + _SQL)


# --- retrieval by five scores ---
_PART = {"concept": 0.4, "temporal": 0.4, "intent": 0.2}
_RAW_MODES = _SQL[: _SQL.index("  modes as (select")]
_add("x21_evidence", lambda t: hybrid.retrieve_evidence(_questions(t), t.events(), _PART, 5, F.col("value") > 200).select("query_id", "evidence_id", "score", "rank"),
     "@events, " + _RAW_MODES + """
  pairs as (select t.query_id, t.raw, t.intent, t.dated, t.s, t.e, t.query_id % 13 = 0 as four, t.query_id % 11 = 0 as between_, t.query_id % 17 = 0 as bad_only, t.analyte = o.analyte as own, o.evidence_id, o.ts, coalesce(o.value > 200, false) as bad
    from typed t join o using (patient_id)),
  placed as (select *, row_number() over (partition by query_id, own order by ts desc, evidence_id desc) - 1 as back, count(*) over (partition by query_id, own) as n,
    min((ts, evidence_id)) filter (where bad and own) over (partition by query_id) as first_bad from pairs),
  timed as (select *, round(case when intent = 'CURRENT_VALUE' then case when own then 1 / (1 + 2.0 * back) else 0 end
      when intent = 'LAST_N' then case when not own then 0 when back < case when four then 4 else 3 end then greatest(0.8, 1 - 0.05 * back) else 0.1 end
      when intent = 'PREVIOUS_VALUE' then case when own and (back = 1 or n = 1) then 1 when own and back = 0 then 0.5 else 0 end
      when intent = 'DATE_COMPARISON' and dated then (ts::date = s::date or ts::date = e::date)::int
      when intent = 'LONGITUDINAL_TREND' then own::int when dated then (ts::date between s::date and e::date)::int else 0.5 end, 6) as temporal,
    case when not (bad_only or intent = 'ABNORMALITY') then 1 when raw like '%first%' and first_bad is not null then case when evidence_id = first_bad[2] then 1 when bad then 0.5 else 0 end else bad::int end as told from placed),
  scored as (select *, case when (dated or between_) and max(temporal) over (partition by query_id) > 0 and temporal = 0 then 0 else round(0.4 * case when own then 0.95 else 0 end + 0.4 * temporal + 0.2 * told, 6) end::double as score from timed)
  select query_id, evidence_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, ts desc, evidence_id) as rank from scored) where rank <= 5""")
_POOL = ORACLE["x21_evidence"].replace("where rank <= 5", "where rank <= 25")


def _reranked(t):
    """The pool of each question's 25 best, those about a trend ranked anew by what a row is in its trajectory."""
    asked = _questions(t)
    pool = hybrid.retrieve_evidence(asked, t.events(), _PART, 25, F.col("value") > 200).select("query_id", "evidence_id", "score").join(asked.select("query_id", "intent"), "query_id")
    return retrieval.rerank(pool, series.trajectory_roles(t.events()).select("evidence_id", "role_score"), F.col("intent") == "LONGITUDINAL_TREND").select("query_id", "evidence_id", "score")


_add("x22_rerank", _reranked, f"""with pool as ({_POOL}), roles as ({_W22}),
  asked as (select user_id as patient_id, event_type as analyte, min(event_id) * 4 + k as query_id from events, range(4) as r(k) group by 1, 2, k)
  select query_id, evidence_id, round(case when score > 0 and {_list(_INTENTS)}[(query_id // 5) % 8 + 1] = 'LONGITUDINAL_TREND' then 0.75 * score + 0.25 * coalesce(role_score, 0.5) else score end, 6)::double as score
  from pool left join roles using (evidence_id)""")
_add_there("x21_evidence_full", lambda t: hybrid.retrieve_evidence(_questions(t), t.events(), retrieval.preset("full"), 5, F.col("value") > 200), "")
QUERIES["x21_evidence_full"] = _Q.pop("x21_evidence_full")
_O.pop("x21_evidence_full")


# --- facts, sentences and their checks ---
def _selected(t):
    """The evidence of the questions above, once, with a flag for values beyond 200."""
    path = scratch(t.spark, "selected")
    selection.select_evidence(_questions(t), t.events(), F.col("value") > 200).withColumn("flag", F.when(F.col("value") > 200, "high")).write.parquet(path)
    return t.spark.read.parquet(path)


_SELECTED = f"with recursive s as (with {SQL_EVENTS}, {_SQL}), f as (select *, case when value > 200 then 'high' end as flag from s)"
_SHEET = _SELECTED + """,
  w as (select *, row_number() over (partition by query_id order by ts, evidence_id) as i, count(*) over (partition by query_id) as n from f),
  g as (select query_id, any_value(mode) as mode, any_value(n) as n, min_by((evidence_id, ts, value, flag), i) as a, max_by((evidence_id, ts, value, flag), i) as z,
    min_by((evidence_id, ts, value, flag), i) filter (where value is not null) as va, max_by((evidence_id, ts, value, flag), i) filter (where value is not null) as vz,
    min_by((evidence_id, ts, value, flag), (value, i)) filter (where value is not null) as lo, min_by((evidence_id, ts, value, flag), (-value, i)) filter (where value is not null) as hi,
    min_by((evidence_id, ts, value, flag), i) filter (where role in ('predecessor', 'only_observation_available')) as p, min_by((evidence_id, ts, value, flag), i) filter (where role = 'reference_latest') as r,
    min_by((evidence_id, ts, value, flag), i) filter (where role in ('first_abnormal', 'abnormal')) as b, min_by((evidence_id, ts, value, flag), i) filter (where role = 'inflection_point') as t from w group by query_id),
  h as (select *, round(greatest((epoch_us(vz[2]) - epoch_us(va[2])) / 86400e6, 0), 2) as span, round(vz[3] - va[3], 4) as delta from g),
  sheet as (select *, case when delta > 1e-4 then 'increased' when delta < -1e-4 then 'decreased' when delta is not null then 'stable' end as dir,
    round(abs(t[3] - va[3] - (epoch_us(t[2]) - epoch_us(va[2])) / nullif(epoch_us(vz[2]) - epoch_us(va[2]), 0)::double * (vz[3] - va[3])), 4) as off from h)"""
_IDS = "case when va[1] = vz[1] then va[1]::varchar else va[1] || ' ' || vz[1] end"
_add("x24_derived_facts", lambda t: claims.derived_facts(_selected(t)).select("query_id", "fact", "value", "word", F.concat_ws(" ", F.transform("contributors", lambda x: x.cast("string"))).alias("contributors"), "start_ts", "end_ts"),
     f"""{_SHEET}, v as (select * from sheet where va is not null)
  select query_id, 'span_days' as fact, span as value, null as word, {_IDS} as contributors, va[2] as start_ts, vz[2] as end_ts from v
  union all select query_id, 'absolute_delta', delta, null, {_IDS}, va[2], vz[2] from v
  union all select query_id, 'relative_change_pct', round(delta / abs(va[3]) * 100, 2), null, {_IDS}, va[2], vz[2] from v where abs(va[3]) > 1e-6
  union all select query_id, 'direction', null, dir, {_IDS}, va[2], vz[2] from v
  union all select query_id, 'slope_per_day', round(delta / span, 6), null, {_IDS}, va[2], vz[2] from v where span > 0
  union all select query_id, 'min_value', lo[3], null, lo[1]::varchar, lo[2], lo[2] from v union all select query_id, 'max_value', hi[3], null, hi[1]::varchar, hi[2], hi[2] from v
  union all select query_id, 'inflection_point', off, null, va[1] || ' ' || t[1] || ' ' || vz[1], t[2], t[2] from v where t[3] is not null""")
_no = lambda x: f"regexp_replace(printf('%.4f', ({x})::double), '\\.?0+$', '')"
_on = lambda x: f"strftime({x}[2], '%Y-%m-%d')"
_of = lambda *rows: "[" + ", ".join(f"{r}[1]" for r in rows) + "]"
_MADE = f"""{_SHEET}, series_ as (select user_id as patient_id, event_type as analyte, min(event_id) * 4 + k as query_id from events, range(4) as r(k) group by 1, 2, k), lists as (select query_id, string_agg({_no("value")} || ' on ' || strftime(ts, '%Y-%m-%d') || ' [' || evidence_id || ']', ', ' order by i) as list, list(evidence_id order by i) as ids from w where mode = 'last_n' group by 1),
  m as (select sheet.*, case when mode in ('dates', 'trend') and n = 1 then 'current' else mode end as told, patient_id, analyte, list, ids from sheet join series_ using (query_id) left join lists using (query_id)),
  told as (
  select query_id, 1 as place, 'Before the latest test, ' || analyte || ' was ' || {_no("p[3]")} || ' on ' || {_on("p")} || ' [' || p[1] || '].' as sentence, {_of("p")} as cited from m where told = 'previous' and p is not null
  union all select query_id, 2, 'The latest ' || analyte || ' is ' || {_no("r[3]")} || ', of ' || {_on("r")} || ' [' || r[1] || '].', {_of("r")} from m where told = 'previous' and p is not null and r is not null
  union all select query_id, 3, 'Between the two, ' || analyte || ' ' || dir || ' by ' || {_no("abs(delta)")} || ' [' || p[1] || ', ' || r[1] || '].', {_of("p", "r")} from m where told = 'previous' and p is not null and r is not null
  union all select query_id, 1, 'The latest ' || analyte || ' is ' || {_no("z[3]")} || ', measured on ' || {_on("z")} || ' [' || z[1] || '].', {_of("z")} from m where told = 'current'
  union all select query_id, 2, 'It was flagged as high [' || z[1] || '].', {_of("z")} from m where told = 'current' and z[4] = 'high'
  union all select query_id, 1, 'The last ' || n || ' values of ' || analyte || ': ' || list || '.', ids from m where told = 'last_n'
  union all select query_id, 2, 'Over these ' || n || ' values, ' || analyte || ' ' || dir || ' by ' || {_no("abs(delta)")} || ' [' || a[1] || ', ' || z[1] || '].', {_of("a", "z")} from m where told = 'last_n' and n > 1
  union all select query_id, 1, case when b is null then 'No abnormal ' || analyte || ' was found; the latest is ' || {_no("z[3]")} || ', of ' || {_on("z")} || ' [' || z[1] || '].' else 'The first abnormal ' || analyte || ' on record is ' || {_no("b[3]")} || ', of ' || {_on("b")} || ' [' || b[1] || '].' end, case when b is null then {_of("z")} else {_of("b")} end from m where told in ('abnormal', 'first_abnormal')
  union all select query_id, 1, analyte || ' was ' || {_no("a[3]")} || ' on ' || {_on("a")} || ' [' || a[1] || '] and ' || {_no("z[3]")} || ' on ' || {_on("z")} || ' [' || z[1] || '].', {_of("a", "z")} from m where told = 'dates'
  union all select query_id, 2, 'It ' || dir || ' by ' || {_no("abs(delta)")} || ' over ' || floor(span)::bigint || ' days [' || a[1] || ', ' || z[1] || '].', {_of("a", "z")} from m where told = 'dates'
  union all select query_id, 1, 'From ' || {_on("a")} || ' to ' || {_on("z")} || ', ' || n || ' values of ' || analyte || ' were recorded [' || a[1] || ', ' || z[1] || '].', {_of("a", "z")} from m where told = 'interval'
  union all select query_id, 2, analyte || ' ' || dir || ' from ' || {_no("a[3]")} || ' to ' || {_no("z[3]")} || ' [' || a[1] || ', ' || z[1] || '].', {_of("a", "z")} from m where told = 'interval' and n > 1
  union all select query_id, 1, analyte || ' went from ' || {_no("a[3]")} || ' on ' || {_on("a")} || ' [' || a[1] || '] to ' || {_no("z[3]")} || ' on ' || {_on("z")} || ' [' || z[1] || '].', {_of("a", "z")} from m where told = 'trend'
  union all select query_id, 2, 'It turned at ' || {_no("t[3]")} || ' on ' || {_on("t")} || ' [' || t[1] || '].', {_of("t")} from m where told = 'trend' and t is not null
  union all select query_id, 3, 'Overall, ' || analyte || ' ' || dir || ' by ' || {_no("abs(delta)")} || ' over ' || floor(span)::bigint || ' days [' || a[1] || ', ' || z[1] || '].', {_of("a", "z")} from m where told = 'trend')"""
_add("x25_claims", lambda t: claims.claims(_selected(t), _questions(t)).select("query_id", "place", "sentence", F.array_join(F.transform("cited", lambda x: x.cast("string")), " ").alias("cited")),
     f"{_MADE} select query_id, place, sentence, array_to_string(cited, ' ') as cited from told")


def _bent(t):
    """The claims, some of them made wrong by a rule on the question: a number, a date, a source of another question, no source."""
    selected = _selected(t)
    made = claims.claims(selected, _questions(t)).select("query_id", "place", "sentence", "cited", F.lit(None).cast("array<double>").alias("numbers"), F.lit(None).cast("array<string>").alias("dates"))
    k = F.col("query_id") % 10
    wrong = F.when(k == 1, F.concat("sentence", F.lit(" Then 123456.7 followed."))).when(k == 2, F.concat("sentence", F.lit(" See 31/12/1901."))).otherwise(F.col("sentence"))
    cited = F.when(k == 3, F.array(F.lit(-7).cast("long"))).when(k == 4, F.array().cast("array<bigint>")).otherwise(F.col("cited"))
    return claims.verify_claims(made.withColumns({"sentence": wrong, "cited": cited}), selected, claims.derived_facts(selected)), selected


# counts of rows and days are read from sentences too, and stand on no row unless they are small or a fact's value
_WRONG = """case query_id % 10 when 1 then ['number not in evidence: 123456.7'] when 2 then ['date not in evidence: 31/12/1901'] when 3 then ['evidence not selected: -7'] when 4 then ['no evidence cited'] else [] end"""
_add("x26_verify_claims", lambda t: (lambda v: v[0].filter("sentence not like '%values%' and sentence not like '%days%'").select("query_id", "place", "grounded", F.array_join("reasons", "; ").alias("reasons")))(_bent(t)),
     f"{_MADE} select query_id, place, len({_WRONG}) = 0 as grounded, array_to_string({_WRONG}, '; ') as reasons from told where sentence not like '%values%' and sentence not like '%days%'")
_add("x26_audit", lambda t: (lambda s: claims.audit(claims.verify_claims(claims.claims(s, _questions(t)), s, claims.derived_facts(s)), s).select("query_id", "claims", "grounded", "utilisation"))(_selected(t)),
     f"""{_MADE}, used as (select query_id, count(distinct id) as used from (select query_id, unnest(cited) as id from told) group by 1), size as (select query_id, count(distinct evidence_id) as n from f group by 1)
  select query_id, count(*) as claims, count(*) as grounded, round(any_value(used) / any_value(size.n)::double, 6) as utilisation from told join used using (query_id) join size using (query_id) group by 1""")


_ALIASES = {"hba1c": "HbA1c", "ldl": "LDL", "creatinine": "Creatinine"}


def _asked(t):
    """A question about each order, in one of six ways; what it must mean follows from the order's own columns."""
    name, d, k = F.when(F.col("o_orderstatus") == "F", "HbA1c").when(F.col("o_orderstatus") == "O", "ldl").otherwise("Creatinine"), F.col("o_orderdate"), F.col("o_orderkey") % 6
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shown = lambda form: F.date_format(d, form)
    text = (
        F.when(k == 0, say(name, " on ", shown("yyyy-MM-dd"))).when(k == 1, say("Is my ", name, " rising?")).when(k == 2, say("show my last ", (F.col("o_orderkey") % 9 + 2).cast("string"), " ", name, " results"))
        .when(k == 3, say(name, " between ", shown("MMMM yyyy"), " and ", (F.year(d) + 1).cast("string"))).when(k == 4, say("was my ", name, " high since ", shown("d MMMM yyyy"))).otherwise(say("compare ", name, " with the one before the latest"))
    )
    return t("orders").select(F.col("o_orderkey").alias("query_id"), text.alias("raw_query"))


_add("x12_parse_questions", lambda t: questions.parse_questions(_asked(t), _ALIASES, "2024-03-31").drop("raw_query", "unresolved", "window_n", "window_unit"), """
  with q as (select o_orderkey as query_id, o_orderkey % 6 as k, o_orderdate::date as d, case o_orderstatus when 'F' then 'HbA1c' when 'O' then 'LDL' else 'Creatinine' end as analyte from orders)
  select query_id, analyte, case k when 0 then d when 3 then date_trunc('month', d)::date when 4 then d end as start_date, case k when 0 then d when 3 then make_date(year(d) + 1, 12, 31) end as end_date,
    case when k = 2 then query_id % 9 + 2 end as wanted, k = 4 as abnormal_only, ['HISTORICAL', 'TREND', 'LAST_N', 'HISTORICAL', 'HISTORICAL', 'COMPARISON'][k + 1] as intent,
    case when k = 5 then 'PREVIOUS' end as against, ['EXACT_DATE', 'ALL_TIME', 'LAST_N', 'BETWEEN', 'SINCE', 'ALL_TIME'][k + 1] as operator, 0.9::double as confidence from q""")
