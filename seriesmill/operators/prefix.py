"""Sums over all rows before each row, in an order of the whole table, without a task that sees the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import scratch


def running(df: DataFrame, order: Sequence[Column], columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``<column>_before``: each column's sum over the rows of the same keys before the row. ``order`` must tell rows of
    equal keys apart. Spark deals the rows by ranges of the order, and equal ones stay together; the ranges are written, so
    that their numbers hold; each range adds up its own rows, and starts from the totals of those before it."""
    path = scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("range_", IntegerType())])).parquet(path)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = ranged.groupBy(*keys, "range_").agg(*(F.sum(c).alias(c) for c in columns))
    # a row for each range and key: as many as there are tasks
    earlier = Window.partitionBy(*keys).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("range_").alias("at_"), *(zero(F.sum(c).over(earlier)).alias(f"{c}_start") for c in columns))
    own = Window.partitionBy(*keys, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("*", *(zero(F.sum(c).over(own)).alias(f"{c}_inside") for c in columns))
    same = F.col("range_") == F.col("at_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return inside.join(starts, same).select(*df.columns, *((F.col(f"{c}_start") + F.col(f"{c}_inside")).alias(f"{c}_before") for c in columns))
