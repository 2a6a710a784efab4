"""Queries of the evaluation operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev

from .cohort_plans import _C, _K, _ST
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


def _sets(t):
    """Per customer, the orders over two limits as gold and as choice."""
    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    return o.filter("o_totalprice > 100000").select("query_id", "id", (F.col("o_totalprice") > 200000).alias("is_primary")), o.filter("o_orderstatus <> 'F'").select("query_id", "id", (F.col("o_totalprice") > 150000).alias("is_primary"))


_add("e12_package_metrics", lambda t: ev.package_metrics(*_sets(t)), """with b as (select o_custkey as query_id, o_totalprice > 100000 as ig, o_orderstatus <> 'F' as ic, o_totalprice > 200000 as gp, o_totalprice > 150000 as cp from orders where o_totalprice > 100000 or o_orderstatus <> 'F'),
  p as (select query_id, count(*) filter (where ig and ic and gp and cp) as h, count(*) filter (where ig and gp) as g, count(*) filter (where ic and cp) as c, count(*) filter (where ig and ic) as v, count(*) filter (where ig) as a from b group by 1)
  select query_id, round(case when c > 0 then h / c::double else 0 end, 6) as precision, round(case when g > 0 then h / g::double else 0 end, 6) as recall, round(case when g + c > 0 then 2 * h / (g + c)::double else 0 end, 6) as f1, round(case when a > 0 then v / a::double else 0 end, 6) as coverage from p""")


def _diagnosed(t):
    o = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    ranked = o.filter("o_orderstatus <> 'P'").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "id")))
    return ev.diagnose(ranked, o.filter("o_totalprice > 150000").select("query_id", "id"), o.filter("id % 50 <> 0"), 4)


_add("e13_diagnose", _diagnosed, """with r as (select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders where o_orderstatus <> 'P'),
  g as (select o_custkey as query_id, o_orderkey, rank from orders left join r using (o_orderkey) where o_totalprice > 150000)
  select query_id, case when count(*) filter (where rank <= 4) = count(*) then 'perfect' when count(*) filter (where o_orderkey % 50 = 0) > 0 then 'unreachable' when count(*) > count(rank) then 'missing' else 'ranking_error' end as diagnosis from g group by 1""")
_add("e14_term_accuracy", lambda t: ev.term_accuracy(t("part").select("p_brand", F.array(F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("unknown"), F.col("p_brand")).alias("g"), (F.col("p_size") % 5 > 0).alias("known")), "p_brand", "g", F.col("known")),
     "select round(count(*) filter (where p_size % 5 > 0 and p_size > 25) / count(*) filter (where p_size % 5 > 0)::double, 6) as top1, 1.0::double as topk, round(count(*) filter (where p_size % 5 = 0 and p_size <= 25) / count(*) filter (where p_size % 5 = 0)::double, 6) as unknown from part")


#: Rows of a task where fields of documents are put together.
_ROWS = 1 << 18


def _fields(t):
    """Both sides dealt once by document and field, over as many tasks as the rows need."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("string").alias("field"), "l_quantity")
    tasks = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // _ROWS))
    i = rows.repartition(tasks, "doc", "field").groupBy("doc", "field").agg(F.max("l_quantity").alias("value"))
    return i.filter("value > 5"), i.filter("value < 45").withColumn("value", F.when(F.col("field") == "3", F.col("value") + 1).otherwise(F.col("value")))


_add("e15_field_metrics", lambda t: ev.field_metrics(*_fields(t)), """with i as (select l_orderkey as doc, l_linenumber as field, max(l_quantity) as v from lineitem group by 1, 2),
  d as (select doc, count(*) filter (where v > 5 and v < 45 and field <> 3) as h, count(*) filter (where v > 5) as g, count(*) filter (where v < 45) as f from i where v > 5 or v < 45 group by 1)
  select round(sum(h) / sum(f)::double, 6) as precision, round(sum(h) / sum(g)::double, 6) as recall, round(2 * sum(h) / (sum(g) + sum(f))::double, 6) as f1, round(count(*) filter (where h = g and h = f) / count(*)::double, 6) as exact from d""")


def _claims(t):
    return t.events().select("analyte", (F.col("evidence_id") % 4 > 0).alias("grounded"), F.when(F.col("evidence_id") % 4 == 0, F.col("evidence_id") % 8).otherwise(0).alias("n_loose"))


_add("e16_grounding_rates", lambda t: ev.grounding_rates(_claims(t), "analyte"), "@events select analyte, count(*) as n, round(avg((evidence_id % 4 > 0)::int), 6) as grounded, round(avg((evidence_id % 8 = 4)::int), 6) as hallucinated, grouping(analyte) as overall from o group by rollup (analyte)")


def _ablated(t):
    o = t.events().withColumn("k", F.concat_ws("|", "patient_id", "analyte"))
    truth = o.groupBy("k").agg((F.max("value") > 250).alias("is_anomaly"))
    m = lambda cut, f: o.groupBy("k").agg((f("value") > cut).alias("alarm"))
    return ev.ablation(truth, "k", {"mean": m(70, F.avg), "max": m(200, F.max)}, "mean")


_S = "with s as (select user_id, event_type, max(value) > 250 as y, avg(value) > 70 as a, max(value) > 200 as b from events group by 1, 2), m as (select 'mean' as method, y, a as g from s union all select 'max', y, b from s), c as (select method, count(*) filter (where y and g) as tp, count(*) filter (where not y and g) as fp, count(*) filter (where y and not g) as fn, count(*) filter (where not y and not g) as tn from m group by 1), r as (select method, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn)::double else 0 end, 6) as f1, round(1 - round(case when tn + fp > 0 then tn / (tn + fp)::double else 0 end, 6), 6) as far from c)"
_add("e18_ablation", _ablated, f"{_S} select r.*, r.f1 - b.f1 >= 0.02 and r.far - b.far <= 0.05 as promoted from r, (select f1, far from r where method = 'mean') b")
_add("e19_answer_rates", lambda t: ev.answer_rates(t("conversations").filter("role = 'assistant'"), "text", F.col("text").contains("http"), ["the", "und"], F.col("text").contains("!!")), "select round(avg((contains(lower(text), 'the') or contains(lower(text), 'und'))::int), 6) as keyword, round(avg(contains(text, 'http')::int), 6) as cited, round(avg(contains(text, '!!')::int), 6) as tone_broken from conversations where role = 'assistant'")
_add("w10_feature_summary", lambda t: ev.feature_summary(t.events(), 4).select("patient_id", "analyte", "n", "baseline", "latest", "delta"), "@events, l as (select *, row_number() over (partition by patient_id, analyte order by ts desc, evidence_id desc) as rn from o) select patient_id, analyte, count(*) as n, arg_min(value, (ts, evidence_id)) as baseline, arg_max(value, (ts, evidence_id)) as latest, round(arg_max(value, (ts, evidence_id)) - arg_min(value, (ts, evidence_id)), 6) as delta from l where rn <= 4 and value is not null group by 1, 2")
_add("m12_scaled_contributions", lambda t: ev.scaled_contributions(t("lineitem"), _C, _K, 1).groupBy("feature").agg(F.count(F.lit(1)).alias("n")), f"with {_ST}, s as (select " + ", ".join(f"round(({c} - m_{c}) / i_{c}, 6) as {c}" for c in _C) + " from lineitem, q) select case when abs(l_discount) >= abs(l_extendedprice) and abs(l_discount) >= abs(l_quantity) then 'l_discount' when abs(l_extendedprice) >= abs(l_quantity) then 'l_extendedprice' else 'l_quantity' end as feature, count(*) as n from s group by 1")
_add("x10_normalise_units", lambda t: ev.normalise_units(t("part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))).otherwise(" ").alias("unit")), t("part").groupBy("p_brand").agg(F.min("p_type").alias("unit")), "p_brand").select("p_partkey", "unit"),
     "select p_partkey, case when p_size % 2 = 0 then p_size::varchar else m end as unit from part join (select p_brand, min(p_type) as m from part group by 1) using (p_brand)")
_add("x14_build_query_text", lambda t: ev.build_query_text(t("part").select(F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("analyte"), F.col("p_name").alias("text")), t("part").select(F.col("p_brand").alias("analyte"), F.col("p_size").cast("string").alias("synonym"))),
     "select p_partkey as query_id, p_name || ' ' || m as text from part join (select p_brand, string_agg(distinct p_size::varchar, ' ' order by p_size::varchar) as m from part group by 1) using (p_brand)")
_add("x28_definition_lookup", lambda t: ev.definition_lookup(t("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("What is "), F.regexp_extract("text", "[A-Za-z0-9-]+", 0), F.lit("?")).alias("text")), t("documents")),
     r"""with q as (select item_id as query_id, lower(regexp_extract(regexp_extract('What is ' || regexp_extract(text, '[A-Za-z0-9-]+') || '?', '(?i)^what (?:is|are) (?:a |an |the )?([A-Za-z0-9-]+)', 1), '.*')) as subject from benchmark),
  f as (select doc_id, regexp_extract_all(text, '(?:^|[.!?]\s+)([A-Za-z0-9-]+ (?:is|are|measures) [^.!?]*[.!?])', 1) as found from documents),
  s as (select doc_id, unnest(found) as sentence, unnest(range(0, len(found))) as at_ from f), k as (select *, lower(regexp_extract(sentence, '^[A-Za-z0-9-]+')) as subject from s)
  select query_id, q.subject, first.sentence from q join (select subject, arg_min(sentence, (doc_id, at_)) as sentence from k group by 1) first on first.subject = q.subject where q.subject <> ''""")
