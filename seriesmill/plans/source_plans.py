"""Sources and sinks over files that Spark writes from the tables at hand, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import terminology
from ..session import scratch
from ..sources import tables
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there

QUERIES: dict = {}
ORACLE: dict = {}
_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _add(name, run, sql):
    _add_there(name, run, sql)
    QUERIES[name], ORACLE[name] = _Q.pop(name), _O.pop(name)


def _observations(t):
    """Events as an observation file: headers with blanks, some values in words."""
    path = scratch(t.spark, "observations-csv")
    value = F.when(F.col("value") > 300, F.lit(" high ")).otherwise(F.col("value").cast("string"))
    t("events").select(
        F.date_format("ts", _STAMP).alias("Date "), F.col("user_id").alias(" PATIENT"), F.concat(F.lit("c-"), "event_type").alias("CODE"),
        F.col("event_type").alias("Description"), value.alias("VALUE"), F.lit("mg").alias("UNITS"), F.col("event_id").alias("ENCOUNTER"),
    ).write.option("header", True).csv(path)
    return tables.read_observations_csv(t.spark, path).select("source_patient_id", "observation_ts", "analyte_raw", "code", "value_numeric", "value_text", "unit")


_add("s1_observations_csv", _observations, """select user_id::varchar as source_patient_id, ts as observation_ts, event_type as analyte_raw, 'c-' || event_type as code,
    case when value > 300 then null else value end as value_numeric, case when value > 300 then 'high' end as value_text, 'mg' as unit from events""")


def _labevents(t):
    """Events as a lab file and a dictionary of items that lacks one."""
    path, item = scratch(t.spark, "labevents-csv"), F.ascii("event_type")
    t("events").select(
        F.col("event_id").alias("labevent_id"), F.col("user_id").alias("subject_id"), item.alias("itemid"), F.date_format("ts", _STAMP).alias("charttime"),
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("valuenum"), F.when(F.col("event_id") % 7 > 0, F.col("value").cast("string")).otherwise(F.lit("neg")).alias("value"),
    ).write.option("header", True).csv(f"{path}/events")
    t("events").filter("event_type <> 'signup'").select(item.alias("itemid"), F.col("event_type").alias("label")).distinct().write.option("header", True).csv(f"{path}/items")
    return tables.read_labevents_csv(t.spark, f"{path}/events", f"{path}/items").select("source_patient_id", "observation_ts", "analyte_raw", "value_numeric", "value_text")


_add("s2_labevents_csv", _labevents, """select user_id::varchar as source_patient_id, ts as observation_ts, case event_type when 'signup' then 'ITEM_115' else event_type end as analyte_raw,
    case when event_id % 3 > 0 or event_id % 7 > 0 then value end as value_numeric, case when (event_id % 3 = 0 or value is null) and event_id % 7 = 0 then 'neg' end as value_text from events""")


def _jsonl(t):
    path = scratch(t.spark, "records-jsonl")
    unit = F.when(F.col("o_orderstatus") != "F", "usd")
    t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("value_numeric"), unit.alias("unit")).write.json(path)
    return tables.read_records_jsonl(t.spark, path, "id string, value_numeric double, unit string, flag string", {"unit": "none", "flag": "-"})


_add("s3_records_jsonl", _jsonl, "select o_orderkey::varchar as id, o_totalprice as value_numeric, case when o_orderstatus <> 'F' then 'usd' else 'none' end as unit, '-' as flag from orders")


def _partitioned(t):
    path = scratch(t.spark, "by-status")
    tables.write_partitioned(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderstatus")
    return t.spark.read.parquet(path)


_add("s4_write_partitioned", _partitioned, "select o_orderkey, o_orderstatus, o_totalprice from orders")


def _knowledge(t):
    """A text file for each nation, headed by its name and number."""
    path = scratch(t.spark, "knowledge-text")
    body = F.concat(F.lit("SOURCE: "), "n_name", F.lit("\nLICENCE: open\nURL: n/"), F.col("n_nationkey").cast("string"), F.lit("\n---\nAbout "), "n_name", F.lit(".\n"))
    t("nation").select(body.alias("value"), "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return tables.read_knowledge_text(t.spark, path).drop("path")


_add("s5_knowledge_text", _knowledge, "select n_name as source, 'open' as licence, 'n/' || n_nationkey as url, 'About ' || n_name || '.' as text from nation")


def _appended(t):
    """Two appends of the orders' halves; orders of status P have no date."""
    path = scratch(t.spark, "appended-values")
    dated = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("ts"), "o_totalprice")
    for half in (0, 1):
        tables.append_values(dated.filter(F.col("o_orderkey") % 2 == half), path, "ts")
    return t.spark.read.parquet(path)


_add("s7_append_values", _appended, "select o_orderkey, o_orderdate as ts, o_totalprice from orders where o_orderstatus <> 'P'")


def _runs(t):
    """Two tables of a run: totals by status, and orders of no value."""
    path = scratch(t.spark, "runs")
    totals = t("orders").groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    failures = t("orders").filter("o_totalprice < 50000").select(F.col("o_orderkey").cast("string").alias("name"), F.lit(0).cast("long").alias("n"))
    tables.save_run(path, "run-1", metrics=totals, failures=failures)
    read = lambda part: t.spark.read.schema("name string, n long, run_id string").json(f"{path}/{part}").withColumn("part", F.lit(part))
    return read("metrics").unionByName(read("failures"))


_add("s8_save_run", _runs, """select o_orderstatus as name, count(*) as n, 'run-1' as run_id, 'metrics' as part from orders group by 1
  union all select o_orderkey::varchar, 0, 'run-1', 'failures' from orders where o_totalprice < 50000""")


#: Measures of the events: known by a code, by an alias in brackets, or not at all.
_WORDS = [("Clicks", "c-1", "n", ["click"]), ("Views", "v-1", "s", ["page views"]), ("Purchases", None, "eur", ["purchase"])]


def _ingested(t):
    path = scratch(t.spark, "cohort")
    e = t("events")
    raw = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"), F.col("user_id").cast("string").alias("PATIENT"), F.when(F.col("event_type") == "click", "c-1").otherwise("?").alias("CODE"),
        F.when(F.col("event_type") == "view", "Seen [Page  Views] today").otherwise(F.col("event_type")).alias("DESCRIPTION"), F.col("value").cast("string").alias("VALUE"),
    )
    raw.write.option("header", True).csv(f"{path}/in")
    out = tables.ingest_cohort(t.spark, f"{path}/in", f"{path}/out", vocabulary=t.spark.createDataFrame(_WORDS, terminology.VOCABULARY), abnormal=F.col("value") > 200)
    return out["observations"].groupBy("split", "analyte", "mapping_status", "concept_id", "unit").agg(F.count_distinct("patient_id").alias("patients"), F.count(F.lit(1)).alias("records"))


_add("s9_ingest_cohort", _ingested, """with k as (select distinct user_id from events), p as (select user_id, row_number() over (order by sha256('42:' || user_id)) as place, count(*) over () as n from k),
  sp as (select user_id, case when place <= round(0.6 * n) then 'train' when place <= round(0.8 * n) then 'dev' else 'test' end as split from p)
  select split, case event_type when 'click' then 'Clicks' when 'view' then 'Views' when 'purchase' then 'Purchases' else event_type end as analyte,
    case event_type when 'click' then 'exact_code' when 'view' then 'alias' when 'purchase' then 'alias' else 'unmapped' end as mapping_status,
    case event_type when 'click' then 'LOINC:c-1' when 'view' then 'LOINC:v-1' end as concept_id, case event_type when 'click' then 'n' when 'view' then 's' when 'purchase' then 'eur' end as unit,
    count(distinct user_id) as patients, count(*) as records from events join sp using (user_id) group by all""")
