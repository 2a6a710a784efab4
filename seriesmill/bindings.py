"""The tables at hand seen as observations: (patient_id, analyte, ts, value, evidence_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import table

KEYS = ("patient_id", "analyte")


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("analyte"), "ts", "value", F.col("event_id").alias("evidence_id")
    )


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("analyte"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("evidence_id"),
    )


#: The same bindings for the DuckDB twins.
SQL_EVENTS = "o as (select user_id as patient_id, event_type as analyte, ts, value, event_id as evidence_id from events)"
SQL_ORDERS = "o as (select o_custkey as patient_id, o_orderpriority as analyte, o_orderdate as ts, o_totalprice as value, o_orderkey as evidence_id from orders)"
