"""Queries of extraction, selection, facts and checks, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import reports as rep
from ..operators import series
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql=None):
    _add_there(name, run, sql or "")
    QUERIES[name] = _Q.pop(name)
    text = _O.pop(name)
    if sql:
        ORACLE[name] = text


#: The items of a made report: test, unit, and the range's bounds.
_TESTS = (("Haemoglobin", "g/dL", "13.0", "17.0"), ("WBC", "/cumm", "4500", "11000"), ("Platelets", "/cumm", "150000", "400000"), ("TSH", "µIU/mL", "0.4", "4.0"), ("Triglycerides", "mg/dL", "", ""), ("HbA1c", "%", "4.0", "5.7"), ("Basophils", "%", "0", "2"))
_BEFORE = {
    0: ("Registration Date: ", "yyyy-MM-dd", -2, "\nSample Collected on ", "dd/MM/yyyy", 1, "; Report Date: ", "dd-MMM-yyyy", 3), 1: ("Printed on ", "MMM d, yyyy", 5, "\nTest date - ", "yyyy/MM/dd", 2, "\nseen ", "d.M.yyyy", 0),
    2: ("DOB: ", "dd/MM/yyyy", -9999, "\nBill date ", "dd MMM yyyy", 0, ", admission date: ", "yyyy-MM-dd", -3), 3: ("Clinic, ", "d MMMM yyyy", 4, "\nNext visit ", "dd-MM-yyyy", 30, "\nResulted on ", "yyyy-MM-dd", 6),
}


def _reports(t):
    """Reports of orders in four layouts, by order number: plain rows; columns; bars; columns in another order. Each has dates, a
    header, a row for each item of the order, rows that are no results, and medicines."""
    i = (F.col("l_linenumber") - 1) % len(_TESTS)
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _TESTS)), (i + 1).cast("int"))
    value = F.when(F.col("l_suppkey") % 2 == 0, F.format_string("%.1f", F.col("l_quantity") / 2)).otherwise(F.replace(F.format_string("%.1f", F.col("l_quantity") / 2), F.lit("."), F.lit(",")))
    ranged = F.when(pick(2) != "", F.concat(pick(2), F.lit(" - "), pick(3))).otherwise(F.lit("< 150"))
    flag = F.when(F.col("l_returnflag") == "A", " H").when(F.col("l_returnflag") == "R", " low").otherwise("")
    kind = F.col("l_orderkey") % 4
    line = F.when(kind == 0, F.concat(pick(0), F.lit(": "), value, F.lit(" "), pick(1), F.lit(" ("), ranged, F.lit(")"), flag)).when(kind == 1, F.concat(pick(0), F.lit("    "), value, F.lit("   "), pick(1), F.lit("   "), ranged, flag))
    line = line.when(kind == 2, F.concat_ws(" | ", pick(0), value, pick(1), F.concat(ranged, flag))).otherwise(F.concat(pick(0), F.lit("\t"), pick(1), F.lit("\t"), ranged, F.lit("\t"), value))
    rows = t("lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity", "l_suppkey", "l_partkey", "l_returnflag", line.alias("line")).alias("r")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("rows"))
    o = t("orders").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    kind, date = F.col("o_orderkey") % 4, lambda form, days: F.date_format(F.date_add("o_orderdate", days), form)
    head = F.coalesce(*(F.when(kind == k, F.concat(*(x for a, form, days in (d[:3], d[3:6], d[6:]) for x in (F.lit(a), date(form, days))))) for k, d in _BEFORE.items()))
    titles = F.when(kind == 1, "TEST NAME    RESULT   UNIT   REFERENCE RANGE").when(kind == 2, "Test | Result | Unit | Reference").when(kind == 3, "Investigation\tUnit\tNormal Range\tValue").otherwise("RESULTS OF THE DAY")
    drug = F.concat(F.lit("\n1. Alphamed "), (F.col("o_custkey") % 90 + 10).cast("string"), F.lit(" mg tablet"))
    told = F.when(F.col("o_custkey") % 3 == 0, "\nInstruction: one daily").when(F.col("o_custkey") % 3 == 1, "\n\n \nSig: at night").otherwise("\nask again\nInstruction: none")
    tail = F.concat(drug, told, F.lit("\nStop Betamed 5 mg tablet\nTablet 5 mg\nThank you"), F.when(F.col("o_orderstatus") == "P", "\nMedicine: Gammamed 7 ml").otherwise(""))
    return o.select("o_orderkey", F.concat(F.lit("COMPLETE REPORT\n"), head, F.lit("\n\n"), titles, F.lit("\n"), "rows", F.lit("\n"), tail).alias("text"))


_TEST_ROWS = ", ".join(f"({k}, '{n}', '{u}', {lo or 'null'}::double, {hi or 'null'}::double)" for k, (n, u, lo, hi) in enumerate(_TESTS))
_ITEMS = f"""tests(i, name, unit, low, high) as (values {_TEST_ROWS}), items as (
  select o_orderkey, o_orderkey % 4 as kind, i, name, unit, low, high, round((l_quantity / 2)::decimal(18, 6), 1)::double as value, case l_returnflag when 'A' then 'high' when 'R' then 'low' end as flag, l_linenumber, l_quantity, l_suppkey, l_partkey, l_returnflag
  from orders join lineitem on l_orderkey = o_orderkey join tests on i = (l_linenumber - 1) % 7)"""
#: Days from the order to each date of a report, by layout: (days, kind, line, place).
_DATES = "dates_(layout, days, kind, line_no, place) as (values (0, -2, 'administrative', 2, 1), (0, 1, 'collection', 3, 1), (0, 3, 'report', 3, 2), (1, 5, 'report', 2, 1), (1, 2, 'test', 3, 1), (1, 0, 'unlabelled', 4, 1), (2, -9999, 'administrative', 2, 1), (2, 0, 'administrative', 3, 1), (2, -3, 'administrative', 3, 2), (3, 4, 'unlabelled', 2, 1), (3, 30, 'unlabelled', 3, 1), (3, 6, 'result', 4, 1))"
_BEST = "best as (select * from (values (0, 1, 'collection', 0.95, 3), (1, 2, 'test', 0.9, 3), (3, 6, 'result', 0.85, 4)) v(layout, days, kind, confidence, line_no))"
_add("x3_lab_lines", lambda t: rep.lab_lines(_reports(t), "o_orderkey", "text").drop("line_no"),
     f"""with {_ITEMS} select o_orderkey, name, value, unit, low as ref_low, high as ref_high, case when kind < 3 then flag end as flag, case when low is null then 0.8 else 0.95 end::double as confidence from items""")
_add("x3_first_of_each", lambda t: rep.first_of_each(rep.lab_lines(_reports(t), "o_orderkey", "text"), "o_orderkey").select("o_orderkey", "name", "value", "unit"),
     f"with {_ITEMS} select o_orderkey, name, arg_min(value, (l_linenumber, l_quantity, l_suppkey, l_partkey, l_returnflag)) as value, unit from items group by o_orderkey, name, unit")
_add("x3_lab_lines_documents", lambda t: rep.lab_lines(t("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
_add("x2_lab_values", lambda t: rep.lab_values(_reports(t), "o_orderkey", "text").withColumn("date", F.col("date").cast("string")),
     f"""with {_ITEMS}, {_BEST}, first as (select o_orderkey, kind, name, unit, low, high, arg_min(value, (l_linenumber, l_quantity, l_suppkey, l_partkey, l_returnflag)) as value from items where kind < 3 group by all)
  select f.o_orderkey, case name when 'TSH' then 'Thyroid' when 'Triglycerides' then 'Lipid Profile' when 'HbA1c' then 'HbA1c' else 'CBC' end as panel, name as test, value, unit, low as ref_low, high as ref_high,
    strftime(o_orderdate + to_days(b.days), '%Y-%m-%d') as date, b.kind as date_kind, b.confidence::double as date_confidence from first f join orders o using (o_orderkey) left join best b on b.layout = f.kind""")
_add("x4_dates", lambda t: rep.dates(_reports(t), "o_orderkey", "text").select("o_orderkey", "line_no", "place", F.col("date").cast("string").alias("date"), "kind"),
     f"with {_DATES} select o_orderkey, line_no, place, strftime(o_orderdate + to_days(days), '%Y-%m-%d') as date, kind from orders join dates_ on layout = o_orderkey % 4 where o_orderkey in (select l_orderkey from lineitem)")
_add("x5_document_date", lambda t: rep.document_date(_reports(t), "o_orderkey", "text").withColumn("date", F.col("date").cast("string")),
     f"with {_BEST} select o_orderkey, strftime(o_orderdate + to_days(days), '%Y-%m-%d') as date, kind, confidence::double as confidence, line_no from orders join best on layout = o_orderkey % 4 where o_orderkey in (select l_orderkey from lineitem)")
_add("x6_medicine_lines", lambda t: rep.medicine_lines(_reports(t), "o_orderkey", "text").select("o_orderkey", "name", "schedule", F.length("evidence").alias("n_evidence")),
     """with known as (select * from orders where o_orderkey in (select l_orderkey from lineitem))
  select o_orderkey, 'Alphamed ' || (o_custkey % 90 + 10) || ' mg tablet' as name, case o_custkey % 3 when 0 then 'one daily' when 1 then 'at night' else '' end as schedule,
    length('1. Alphamed 10 mg tablet') + case o_custkey % 3 when 0 then length('Instruction: one daily') + 1 when 1 then length('Sig: at night') + 4 else 0 end as n_evidence from known
  union all select o_orderkey, 'Tablet 5 mg', '', length('Tablet 5 mg') from known
  union all select o_orderkey, 'Gammamed 7 ml', '', length('Medicine: Gammamed 7 ml') from known where o_orderstatus = 'P'""")
_add("x11_noisy_variants", lambda t: ex.noisy_variants(t("part").select("p_brand").distinct(), "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")), "select p_brand, count(distinct v) as n from (select p_brand, unnest([p_brand, upper(p_brand), lower(p_brand), p_brand || '.', '- ' || p_brand, p_brand || ' (serum)']) as v from (select distinct p_brand from part)) group by 1")


def _terms(t):
    names = t("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.col("n_name"), F.lit("s"))).alias("name"))
    return ex.normalise_terms(names, t("nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("label"))).select("id", "label")


_add("x9_normalise_terms", _terms)
_add("w9_compare_periods", lambda t: ex.compare_periods(t.events(), "2024-01-10", "2024-01-20"), """@events, p as (select patient_id, analyte, arg_min((evidence_id, value), (abs(epoch_us(ts) - epoch_us(timestamp '2024-01-10')), ts, evidence_id)) as a, arg_min((evidence_id, value), (abs(epoch_us(ts) - epoch_us(timestamp '2024-01-20')), ts, evidence_id)) as b from o group by 1, 2)
  select patient_id, analyte, a[1] as evidence_id, a[2] as value, 'period_start' as role from p union all select patient_id, analyte, b[1], b[2], 'period_end' from p where a <> b""")
_add("j14_cite_facts", lambda t: ex.cite_facts(t.orders().groupBy("patient_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("cited")), t.orders().withColumn("y", F.year("ts")).groupBy("patient_id", "y").agg(F.collect_set("evidence_id").alias("contributors")), "patient_id").select("patient_id", "y"), "@orders select distinct patient_id, year(ts) as y from o")
_add("x20_intent_score", lambda t: ex.intent_score(t.events(), F.col("value") > 150, True), "@events select patient_id, analyte, evidence_id, case when value > 150 and row_number() over (partition by patient_id, analyte, value > 150 order by ts, evidence_id) = 1 then 1.0 when value > 150 then 0.5 else 0.0 end::double as s_intent from o")
