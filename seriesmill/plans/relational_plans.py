"""Queries of filters, joins, aggregates, set operations and top-k, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import SQL_EVENTS, SQL_ORDERS, obs_events, obs_orders
from ..operators import aggregates as agg
from ..operators import relational as rel
from ..operators import series
from ..session import table

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql):
    """run(t), where t(name) reads a table and t.events, t.orders are the bindings."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = lambda n: table(spark, sf_dir, n)
        t.events, t.orders, t.spark = lambda: obs_events(spark, sf_dir), lambda: obs_orders(spark, sf_dir), spark
        return run(t)

    QUERIES[name] = query
    ORACLE[name] = sql.replace("@events", f"with {SQL_EVENTS}").replace("@orders", f"with {SQL_ORDERS}")


# --- filters ---
_add("p1_scope_filter", lambda t: rel.scope_filter(t.events(), 7), "@events select * from o where patient_id = 7")
_add("p2_scope_predicate", lambda t: t("orders").withColumn("p", F.when(F.col("o_orderstatus") != "O", F.col("o_custkey"))).filter(rel.scope_predicate(F.col("p"), F.col("o_custkey"), 5, 8)).select("o_orderkey", "o_custkey", "p"),
     "select o_orderkey, o_custkey, case when o_orderstatus <> 'O' then o_custkey end as p from orders where (case when o_orderstatus <> 'O' then o_custkey end) = 5 or ((case when o_orderstatus <> 'O' then o_custkey end) is null and o_custkey = 8)")
for _op, _sql in (("EXACT", "= date '1995-03-15'"), ("BETWEEN", "between date '1995-03-15' and date '1996-02-01'"), ("BEFORE", "< date '1995-03-15'"), ("AFTER", "> date '1995-03-15'"), ("SINCE", ">= date '1995-03-15'")):
    _add(f"p3_date_window_{_op.lower()}", lambda t, op=_op: rel.date_window(t.orders(), "ts", op, "1995-03-15", "1996-02-01" if op == "BETWEEN" else None).select("evidence_id", "ts"), f"@orders select evidence_id, ts from o where ts::date {_sql}")
_add("p4_relative_window", lambda t: rel.relative_window(t.orders(), "ts", "1996-03-31", 1, "month").select("evidence_id", "ts"), "@orders select evidence_id, ts from o where ts::date between date '1996-02-29' and date '1996-03-31'")


def _limits(t, inclusive):
    return t.spark.createDataFrame([("click", 5.0, 150.0, False, True), ("purchase", 10.0, 120.0, True, False), ("error", 0.0, 80.0, False, False)], "analyte string, low double, high double, low_inclusive boolean, high_inclusive boolean") if inclusive else t.spark.createDataFrame([("click", 5.0, 150.0), ("purchase", 10.0, 120.0), ("error", 0.0, 80.0)], "analyte string, low double, high double")


def _flagged(t):
    i = F.col("evidence_id")
    return t.events().withColumns({"flag": F.when(i % 11 == 0, "H").when(i % 13 == 0, "normal"), "ref_low": F.when(i % 3 == 0, 20.0), "ref_high": F.when(i % 3 == 0, 90.0)})


_FL = "f as (select *, case when evidence_id % 11 = 0 then 'H' when evidence_id % 13 = 0 then 'normal' end as flag, case when evidence_id % 3 = 0 then 20.0 end as ref_low, case when evidence_id % 3 = 0 then 90.0 end as ref_high from o)"
_add("p5_abnormal_cohort", lambda t: rel.abnormal_cohort(_flagged(t), _limits(t, True)).select("evidence_id", "abnormal"), f"""@events, {_FL} select evidence_id, coalesce(flag = 'H', false) or coalesce(value < ref_low or value > ref_high, false) or
  case analyte when 'click' then coalesce(value < 5 or value >= 150, false) when 'purchase' then coalesce(value <= 10 or value > 120, false) when 'error' then coalesce(value < 0 or value > 80, false) else false end as abnormal from f""")
_add("p6_abnormal_strict", lambda t: rel.abnormal_strict(_flagged(t), _limits(t, False)).select("evidence_id", "abnormal"), f"""@events, {_FL} select evidence_id, case when flag = 'normal' then false when flag = 'H' then true when ref_low is not null then not (value between ref_low and ref_high)
  else case analyte when 'click' then coalesce(value < 5 or value >= 150, false) when 'purchase' then coalesce(value < 10 or value >= 120, false) when 'error' then coalesce(value < 0 or value >= 80, false) else false end end as abnormal from f""")
_add("p7_range_status", lambda t: t("lineitem").groupBy(rel.range_status(F.col("l_quantity"), F.lit(10.0), F.when(F.col("l_returnflag") != "R", 40.0)).alias("status")).agg(F.count(F.lit(1)).alias("n")),
     "select case when l_quantity is null then 'unknown' when l_quantity < 10 then 'low' when l_quantity > (case when l_returnflag <> 'R' then 40 end) then 'high' else 'normal' end as status, count(*) as n from lineitem group by 1")
_add("p8_hard_gate", lambda t: rel.hard_gate(t.events().withColumns({"score": F.lit(1.0), "inside": F.to_date("ts") == F.lit("2024-01-05").cast("date"), "explicit": F.col("patient_id") % 2 == 0}), "patient_id", "inside", "explicit").select("evidence_id", "score"),
     "@events select evidence_id, case when patient_id % 2 = 0 and max((ts::date = date '2024-01-05')::int) over (partition by patient_id) = 1 and ts::date <> date '2024-01-05' then 0.0 else 1.0 end::double as score from o")
_add("p9_eligible", lambda t: rel.eligible(t.events().withColumns({"score": F.col("value") - 50, "wanted": F.col("patient_id") - F.col("evidence_id") % 2}), "patient_id", "wanted").select("evidence_id"), "@events select evidence_id from o where evidence_id % 2 = 0 and value > 50")
_add("p10_clean_date", lambda t: t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("s")).select("o_orderkey", rel.clean_date(F.col("s")).alias("d")).filter("d is not null"), "select o_orderkey, o_orderdate::date as d from orders where o_orderkey % 5 <> 0")
_add("p11_real_files", lambda t: rel.real_files(t("pages").withColumn("path", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("demo://"), "url")).otherwise(F.col("url"))), "path").select("page_id"), "select page_id from pages where page_id % 4 <> 0")
_add("p12_fill_date", lambda t: rel.fill_date(t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 1, F.col("l_shipdate")).alias("d")), t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey", "d", "o_orderdate"),
     "select l_orderkey, l_linenumber, case when l_linenumber > 1 then l_shipdate else o_orderdate end as d from lineitem left join orders on l_orderkey = o_orderkey")
_add("p13_filter_then_topk", lambda t: rel.filter_then_topk(t("customer"), {"c_mktsegment": "building"}, "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "rank"),
     "select c_nationkey, c_custkey, rank from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer where lower(c_mktsegment) = 'building') where rank <= 3")
_add("p14_quality_gate", lambda t: rel.quality_gate(t("part"), [("cheap", F.col("p_retailprice") < 950, 30.0), ("large", F.col("p_size") > 40, 25.0), ("odd", F.col("p_size") % 7 == 0, 10.0)]).select("p_partkey", "score", F.array_join("problems", ",").alias("problems"), "ready"),
     "select *, score >= 60 as ready from (select p_partkey, (100 - case when p_retailprice < 950 then 30 else 0 end - case when p_size > 40 then 25 else 0 end - case when p_size % 7 = 0 then 10 else 0 end)::double as score, concat_ws(',', case when p_retailprice < 950 then 'cheap' end, case when p_size > 40 then 'large' end, case when p_size % 7 = 0 then 'odd' end) as problems from part)")
_add("p15_search_rows", lambda t: rel.search_rows(t("customer"), "MACHINERY", "c_custkey").select("c_custkey"), "select c_custkey from customer where lower(c_mktsegment) like '%machinery%' or lower(c_name) like '%machinery%'")
# --- joins ---
_add("j1_dictionary_join", lambda t: rel.dictionary_join(t("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber"), t("part").filter("p_size < 25").select("p_partkey", "p_name"), "p_partkey", "p_name"),
     "select l_partkey as p_partkey, l_orderkey, l_linenumber, coalesce(p_name, 'ITEM_' || l_partkey) as p_name from lineitem left join (select * from part where p_size < 25) on l_partkey = p_partkey")
_add("j2_map_terms", lambda t: rel.map_terms(t("orders").select("o_orderkey", F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("name")), t.spark.createDataFrame([("F", "finished")], "code string, canonical string"), t.spark.createDataFrame([("1-urgent", "urgent"), ("2-high", "high")], "alias string, canonical string")).groupBy("canonical", "mapping_status").count(),
     "select canonical, mapping_status, count(*) as count from (select case when o_orderstatus = 'F' then 'finished' when lower(o_orderpriority) = '1-urgent' then 'urgent' when lower(o_orderpriority) = '2-high' then 'high' end as canonical, case when o_orderstatus = 'F' then 'code' when lower(o_orderpriority) in ('1-urgent', '2-high') then 'alias' else 'unmapped' end as mapping_status from orders) group by 1, 2")
_add("j3_assign_split", lambda t: rel.assign_split(t.orders(), t("customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("patient_id"), F.when(F.col("c_nationkey") < 10, "train").otherwise("dev").alias("split")), "patient_id").groupBy("split").count(),
     "@orders select coalesce(case when c_nationkey < 10 then 'train' when c_nationkey < 20 then 'dev' end, 'unassigned') as split, count(*) as count from o left join customer on c_custkey = patient_id group by 1")
_add("j4_scoped_semi", lambda t: rel.scoped_semi(t("lineitem"), t("orders").filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")), "select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1")
_add("j5_missing_candidates", lambda t: rel.missing_candidates(t("documents").select("doc_id"), t("labels"), "doc_id"), "select doc_id from documents where doc_id not in (select doc_id from labels)")
_add("j6_result_outcome", lambda t: rel.result_outcome(t("labels").filter("quality = 1"), t("documents").filter("n_chars > 1500"), ["doc_id"]).groupBy("outcome").count(),
     "select case when a.doc_id is not null and b.doc_id is not null then 'hit' when a.doc_id is not null then 'miss' else 'extra' end as outcome, count(*) as count from (select doc_id from labels where quality = 1) a full join (select doc_id from documents where n_chars > 1500) b on a.doc_id = b.doc_id group by 1")


def _questions(t):
    o = t.orders().groupBy("patient_id").agg(F.min("ts").alias("first"))
    return o.select(F.col("patient_id").alias("query_id"), "patient_id", F.to_date("first").alias("start"), F.date_add(F.to_date("first"), 365).alias("end"))


_QU = "q as (select patient_id as query_id, patient_id, min(ts)::date as start, (min(ts)::date + 365)::date as \"end\" from o group by 1)"
_add("j7_query_pairs", lambda t: rel.query_pairs(_questions(t).select("query_id", "patient_id"), t.orders()).groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "@orders select patient_id as query_id, count(*) as n from o group by 1")
_add("j8_window_join", lambda t: rel.window_join(_questions(t), t.orders(), ["patient_id"], "ts", "start", "end").select("query_id", "evidence_id"), f"@orders, {_QU} select query_id, evidence_id from q join o using (patient_id) where ts::date between q.start and q.\"end\"")
_add("j9_nearest", lambda t: rel.nearest(_questions(t).select("query_id", "patient_id", F.col("end").cast("timestamp_ntz").alias("at")), t.orders().select("patient_id", "ts", "evidence_id"), ["patient_id"], "at", "ts", "evidence_id").select("query_id", "evidence_id"),
     f"@orders, {_QU} select query_id, arg_min(evidence_id, (abs(epoch_us(ts) - epoch_us(q.\"end\"::timestamp)), ts, evidence_id)) as evidence_id from q join o using (patient_id) group by 1")
# --- aggregates ---
_add("a1_quality_audit", lambda t: agg.quality_audit(t.events()), """@events select count(*) as n_rows, count(distinct patient_id) as n_patients, count(distinct analyte) as n_analytes, min(ts)::date as first_date, max(ts)::date as last_date, count(*) - count(ts) as missing_dates, count(*) - count(value) as missing_values, round(100.0 * count(value) / count(*), 4) as coverage_pct,
  (select count(distinct patient_id) from (select patient_id, analyte from o group by 1, 2 having count(*) >= 2)) as longitudinal_patients, (select coalesce(sum(c - 1), 0)::bigint from (select count(*) as c from o group by patient_id, analyte, ts, value)) as duplicates from o""")
_add("a2_breakdown", lambda t: agg.breakdown(t("events"), "event_type"), "select event_type, count(*) as n from events group by 1")
_add("a3_longitudinal_keys", lambda t: agg.longitudinal_keys(t.events(), 12), "@events select distinct patient_id from (select patient_id, analyte from o group by 1, 2 having count(*) >= 12)")
_add("a4_duplicate_count", lambda t: agg.duplicate_count(t("orders"), ["o_custkey", "o_orderpriority"]), "select (count(*) - (select count(*) from (select distinct o_custkey, o_orderpriority from orders)))::bigint as duplicates from orders")
_add("a7_ols_slope", lambda t: t.orders().withColumn("d", series.days()).groupBy("patient_id").agg(F.round(F.coalesce(F.regr_slope("value", "d"), F.lit(0.0)), 5).alias("slope")), "@orders select patient_id, round(coalesce(nullif(regr_slope(value, epoch_us(ts) / 86400e6), 'nan'::double), 0), 5) as slope from o group by 1")
_add("a9_timeline_summary", lambda t: agg.timeline_summary(t.events()), "@events select patient_id, analyte, arg_max(value, (ts, evidence_id)) as latest, max(ts) as latest_ts, count(*) as n from o group by 1, 2")
_add("a10_latest_wide", lambda t: agg.latest_wide(t.events(), ["click", "purchase", "error", "signup", "view"]), "@events select patient_id, " + ", ".join(f"arg_max(value, (ts, evidence_id)) filter (where analyte = '{a}') as {a}" for a in ("click", "purchase", "error", "signup", "view")) + " from o group by 1")
_add("a11_medians", lambda t: agg.medians(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "select quantile_cont(l_quantity, 0.5) as l_quantity, quantile_cont(l_extendedprice, 0.5) as l_extendedprice, quantile_cont(l_discount, 0.5) as l_discount from lineitem")
_add("a12_robust_stats", lambda t: agg.robust_stats(t("lineitem").filter("l_quantity < 45"), ["l_quantity", "l_extendedprice"]), "select " + ", ".join(f"round(quantile_cont({c}, 0.5), 6) as {c}_median, round(greatest(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0.001), 6) as {c}_iqr" for c in ("l_quantity", "l_extendedprice")) + " from lineitem where l_quantity < 45")
_add("a13_storage_usage", lambda t: agg.storage_usage(t("documents"), "source", "n_chars", F.col("lang") == "en"), "select source, sum(coalesce(n_chars, 0))::bigint as used, count(*) as files, count(*) filter (where lang = 'en') as counted from documents group by 1")
_add("a14_best_year", lambda t: agg.best_year(t.orders()), "@orders select patient_id, analyte, year, n from (select patient_id, analyte, year(ts) as year, count(*) as n, row_number() over (partition by patient_id, analyte order by count(*) desc, year(ts)) as rn from o group by 1, 2, 3) where rn = 1")
_add("a15_group_modes", lambda t: agg.group_modes(t.events(), F.col("value") > 150), "@events select patient_id, analyte, bool_or(value > 150) as any_abnormal, arg_min(evidence_id, (ts, evidence_id)) filter (where value > 150) as first_abnormal_id from o group by 1, 2")
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_add("a16_correlation_matrix", lambda t: agg.correlation_matrix(t("lineitem"), _NUM), " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 3) as r from lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]))
_add("a17_non_constant", lambda t: agg.non_constant(t("lineitem").withColumn("one", F.lit(1.0)), [*_NUM, "one"]), " union all ".join(f"select '{c}' as \"column\", round(stddev_pop({c}), 6) as std from lineitem" for c in _NUM))
_add("a18_select_by_correlation", lambda t: agg.select_by_correlation(t("lineitem").withColumn("one", F.lit(1.0)), ["l_quantity", "l_discount", "l_tax", "one"], "l_extendedprice", 2), "select * from (" + " union all ".join(f"select '{c}' as \"column\", round(corr({c}, l_extendedprice), 4) as r from lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ') order by abs(r) desc, "column" limit 2')
_add("a19_latency_summary", lambda t: agg.latency_summary(t("events"), "value"), "select round(avg(value), 6) as mean, round(list_sort(list(value))[round(0.5 * (count(*) - 1))::int + 1], 6) as p50, round(list_sort(list(value))[round(0.95 * (count(*) - 1))::int + 1], 6) as p95, max(value) as max from events")
_add("a20_consultation_summary", lambda t: agg.consultation_summary(t("orders"), t("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("scopes")), "o_custkey", "o_orderpriority", "o_orderkey"),
     "select o_custkey, coalesce(string_agg(o_orderpriority || '=' || n, ';' order by o_orderpriority) filter (where shared), '') as sections, coalesce(string_agg(o_orderpriority, ',' order by o_orderpriority) filter (where not shared), '') as unshared from (select o_custkey, o_orderpriority, count(*) as n, o_custkey % 3 <> 0 and o_custkey in (select c_custkey from customer) and o_orderpriority in ('1-URGENT', '2-HIGH') as shared from orders group by 1, 2) group by 1")
_add("a21_risk_rollup", lambda t: agg.risk_rollup(t.events().groupBy("patient_id", F.col("analyte").alias("condition")).agg((F.avg((F.col("value") > 60).cast("int"))).alias("probability")), "patient_id"),
     "@events, c as (select patient_id, analyte as condition, avg((value > 60)::int) as p from o group by 1, 2) select patient_id, round(avg(p), 6) as mean_p, arg_max(condition, (p, condition)) as top_condition, case when max(p) >= 0.66 then 'high' when max(p) >= 0.33 then 'moderate' else 'low' end as band from c group by 1")
_add("a22_cohort_counts", lambda t: agg.cohort_counts(t.orders().withColumn("split", F.when(F.col("patient_id") % 5 == 0, "test").otherwise("train"))), "@orders select case when patient_id % 5 = 0 then 'test' else 'train' end as split, count(*) as records, count(distinct patient_id) as patients from o group by 1")
_add("a23_unit_consistency", lambda t: agg.unit_consistency(t("lineitem"), ["l_suppkey"], "l_returnflag"), "select l_suppkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as units, count(distinct l_returnflag) > 1 as mixed from lineitem group by 1")
# --- sets and top-k ---
_add("u1_split_overlap", lambda t: rel.split_overlap(t.orders().withColumn("split", F.when(F.col("evidence_id") % 4 == 0, "test").otherwise("train")), "patient_id"), "@orders select patient_id, count(distinct evidence_id % 4 = 0) as n_splits from o group by 1 having count(distinct evidence_id % 4 = 0) > 1")
_add("u2_merge_sources", lambda t: rel.merge_sources(t("documents").select("doc_id", "text", "lang"), t("benchmark").select(F.col("item_id").alias("doc_id"), "text")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "select lang, count(*) as n from (select lang from documents union all select null from benchmark) group by 1")
_add("u3_selection_union", lambda t: rel.selection_union(series.latest(t.events()).select("evidence_id", "ts"), series.last_n(t.events(), 3).select("evidence_id", "ts"), "evidence_id"),
     "@events, r as (select *, row_number() over (partition by patient_id, analyte order by ts desc, evidence_id desc) as rn from o) select evidence_id, ts, rn = 1 as is_primary from r where rn <= 3")
_add("u4_fabricated_ids", lambda t: rel.fabricated_ids(t.orders().groupBy("patient_id").agg(F.collect_set("evidence_id").alias("cited")), t.orders().filter("value > 50000").groupBy("patient_id").agg(F.collect_set("evidence_id").alias("known")), "cited", "known", "patient_id").select("patient_id", F.size("fabricated").cast("long").alias("n")),
     "@orders select patient_id, count(*) filter (where value <= 50000) as n from o group by 1 having count(*) filter (where value <= 50000) > 0 and count(*) filter (where value > 50000) > 0")
_add("u5_set_scores", lambda t: rel.result_outcome(t("labels").filter("quality = 1"), t("labels").filter("toxic = 0"), ["doc_id"]).agg(F.count_if(F.col("outcome") == "hit").alias("both"), F.count_if(F.col("outcome") == "miss").alias("gold_only"), F.count_if(F.col("outcome") == "extra").alias("pred_only")),
     "select count(*) filter (where quality = 1 and toxic = 0) as both, count(*) filter (where quality = 1 and toxic = 1) as gold_only, count(*) filter (where quality = 0 and toxic = 0) as pred_only from labels")
_add("w1_rank_results", lambda t: rel.rank_results(t.events().withColumn("score", F.col("value") / 10), "patient_id", 5).select("patient_id", "evidence_id", "rank"), "@events select * from (select patient_id, evidence_id, row_number() over (partition by patient_id order by round(value / 10, 6) desc, ts desc, evidence_id) as rank from o) where rank <= 5")
_add("t1_list_for_owner", lambda t: rel.page(t("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 40), "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 40")
_add("t2_history_for_test", lambda t: rel.page(t.events().filter("analyte = 'purchase'").select("evidence_id", "ts"), [F.col("ts"), F.col("evidence_id")], 200), "@events select evidence_id, ts from o where analyte = 'purchase' order by ts, evidence_id limit 200")
_add("t3_recent_values", lambda t: rel.page(rel.scoped_semi(t("lineitem"), t("orders").filter("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_shipdate"), [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")], 50),
     "select l_orderkey, l_linenumber, l_shipdate from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'O') order by l_shipdate desc, l_orderkey desc, l_linenumber desc limit 50")
_add("t4_audit_page", lambda t: rel.page(t("events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 100, 100), "select event_id, ts from events order by ts desc, event_id desc limit 100 offset 100")
_add("t5_topk_positive", lambda t: rel.topk_positive(t("documents").withColumn("score", F.col("n_chars") - 1000), "source", 5, "score", "doc_id").select("source", "doc_id", "rank"), "select source, doc_id, rank from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents where n_chars > 1000) where rank <= 5")
_add("t6_topk_unique_label", lambda t: rel.topk_unique_label(t("customer"), "c_nationkey", "c_mktsegment", 3, "c_acctbal"), "select * from (select c_nationkey, c_mktsegment, max(c_acctbal) as c_acctbal, row_number() over (partition by c_nationkey order by max(c_acctbal) desc, c_mktsegment) as rank from customer group by 1, 2) where rank <= 3")
_add("t7_merge_topk", lambda t: rel.merge_topk(t("customer").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("score"), F.concat(F.lit("c"), "c_custkey").alias("id")), t("supplier").select(F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("score"), F.concat(F.lit("s"), "s_suppkey").alias("id")), "n", 3, "score", "id"),
     "select * from (select *, row_number() over (partition by n order by score desc, id) as rank from (select c_nationkey as n, c_acctbal as score, 'c' || c_custkey as id from customer union all select s_nationkey, s_acctbal, 's' || s_suppkey from supplier) where score > 0) where rank <= 3")
_add("t8_top_errors", lambda t: rel.top_errors(t("orders").withColumn("guess", F.when(F.col("o_totalprice") > 200000, "F").otherwise("O")), "o_orderstatus", "guess", 5), "select o_orderstatus, guess, count(*) as count from (select *, case when o_totalprice > 200000 then 'F' else 'O' end as guess from orders) where o_orderstatus <> guess group by 1, 2 order by 3 desc, 1, 2 limit 5")
