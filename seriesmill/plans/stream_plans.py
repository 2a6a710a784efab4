"""Batch twins of the streaming jobs over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import jobs
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there
from .series_plans import ORACLE as _SERIES

_MONITOR = _SERIES["w16_monitor"]

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql=None):
    _add_there(name, run, sql or "")
    QUERIES[name] = _Q.pop(name)
    text = _O.pop(name)
    if sql:
        ORACLE[name] = text


_add("g1_rate_alerts", lambda t: jobs.rate_alerts(t("events").filter("event_type = 'error'"), "user_id", "ts", 86400, 2).groupBy("key").agg(F.count_if("alert").alias("alerts"), F.max("n").alias("most")),
     """with recursive e as (select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type = 'error'),
  f as (select user_id, i, us, us as begun, 1 as n from e where i = 1
    union all select e.user_id, e.i, e.us, case when e.us - f.begun >= 86400000000 then e.us else f.begun end, case when e.us - f.begun >= 86400000000 then 1 else f.n + 1 end from f join e on e.user_id = f.user_id and e.i = f.i + 1)
  select user_id::varchar as key, count(*) filter (where n > 2) as alerts, max(n) as most from f group by 1""")
_FOLD = """{p}e as (select {k} as key, epoch_us(ts) as us, row_number() over (partition by {k} order by ts, event_id) as i from events where event_type = 'error'),
  {p}f as (select key, i, us, us as begun, 1 as n from {p}e where i = 1
    union all select e.key, e.i, e.us, case when e.us - f.begun >= 21600000000 then e.us else f.begun end, case when e.us - f.begun >= 21600000000 then 1 else f.n + 1 end from {p}f f join {p}e e on e.key is not distinct from f.key and e.i = f.i + 1)"""
_add("g1_login_alerts", lambda t: jobs.login_alerts(t("events").filter("event_type = 'error'").withColumn("account", F.col("user_id") % 20), "event_type", "account", "ts", b"key", 21600).groupBy("scope", "alert").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum("retry_after").alias("wait"), F.count_distinct("key").alias("keys")),
     f"""with recursive {_FOLD.format(p="a", k="event_type")}, {_FOLD.format(p="b", k="(user_id % 20)")}, every as (select 'source' as scope, key::varchar as key, us, begun, n, n > 60 as alert from af union all select 'source_email', key::varchar, us, begun, n, n > 8 from bf)
  select scope, alert, count(*) as rows, sum(n)::bigint as n, sum(case when alert then greatest(1, floor((begun + 21600000000 - us) / 1000000)) end)::bigint as wait, count(distinct key) as keys from every group by 1, 2""")


def _drained(t):
    """The monitor as a stream over the events, run to its end into the shared folder and read back."""
    events = t.events()
    path = scratch(t.spark, "monitor")
    events.select("patient_id", "analyte", "ts", "value", "evidence_id").write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(t.spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    jobs.drain(jobs.monitor_stream(stream), f"{path}/out", f"{path}/state")
    return jobs.last_word(t.spark.read.parquet(f"{path}/out")).drop("at_us")


_add("g3_monitor_stream", _drained, _MONITOR)
_add("g2_timeline", lambda t: jobs.timeline(t("events").unionByName(t("events").filter("event_id % 10 = 0")), "ts", ["event_id", "user_id", "ts"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "select event_type, count(*) as n from events group by 1")
_add("g4_rules", lambda t: jobs.rule_stream(t("conversations"), ["conv_id", "turn"], "text", [(1, "question", r"\?"), (2, "list", r"\|")]), r"select conv_id, turn, case when regexp_matches(text, '\?') then 'question' when regexp_matches(text, '\|') then 'list' end as category from conversations")
_add("g6_activity_windows", lambda t: jobs.activity_windows(t("events"), "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz")), "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
_add("g7_sessions", lambda t: jobs.gaps(t("events"), "user_id", "ts", 86400).groupBy("user_id").agg(F.max("session").alias("sessions")),
     "select user_id, sum(fresh)::bigint as sessions from (select user_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 86400000000 then 0 else 1 end as fresh from events) group by 1")
