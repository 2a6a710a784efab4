"""What the training-data operators share: durable cut points, word rules, per-text mapping."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are none of the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; on a local master, where one machine does all the work, a new
    temporary one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it again: later plans start from durable files,
    not from lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.settled_path
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; any other column is left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to its machine: workers live on between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has such a call
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], columns: str) -> DataFrame:
    """doc_id and, for each whole text, the tuple that ``make()(text)`` gives; ``make`` runs once in each task."""
    names = [c.strip().split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()
        for whole in batches:
            for at in range(0, len(whole), 1000):  # few results at a time
                batch = whole.iloc[at : at + 1000]
                out = pd.DataFrame([one(t) for t in batch["text"]], columns=names)
                out.insert(0, "doc_id", batch["doc_id"].array)
                yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInPandas(run, f"doc_id {kind}, {columns}")


def map_many(docs: DataFrame, make: Callable[[], Callable[[list[str]], Iterator[tuple]]], columns: str, rows: int = 4000, leave_tidy: bool = False) -> DataFrame:
    """As ``map_texts``, with ``make()`` taking the whole texts of up to ``rows`` rows at a time. ``leave_tidy``: give memory back
    before and after each task."""
    names = [c.strip().split()[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if leave_tidy:
            tidy()
        of = make()
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.iloc[at : at + rows]
                out = pd.DataFrame(list(of(batch["text"].tolist())), columns=names)
                out.insert(0, "doc_id", batch["doc_id"].array)
                yield out
        if leave_tidy:
            del of
            tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInPandas(run, f"doc_id {kind}, {columns}")


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds
