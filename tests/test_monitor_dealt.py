"""The monitor's series are dealt over a fixed number of groups, each with one state."""

import random

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import series
from seriesmill.streaming import jobs


def test_series_share_states(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None if s == 0 else s, None if s == 1 else "x", 600 * j + rng.randint(0, 3000), 100 * s + rng.gauss(0, 1) + (9 if j > 30 else 0), 100 * s + j) for s in range(20) for j in range(40)]
    rows += [(50, "x", 5, 1.0, 9001), (None, None, 5, 1.0, 9002), (None, None, 6, 1.0, 9003)]
    rows.sort(key=lambda r: r[2] // 4000)
    for b in range(4):
        part = spark.createDataFrame(rows[b * len(rows) // 4 : (b + 1) * len(rows) // 4], "patient_id long, analyte string, s long, value double, evidence_id long")
        part.select("patient_id", "analyte", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "value", "evidence_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    everything = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.drain(jobs.monitor_stream(stream, groups=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    # three groups, and those with a null key apart by which are null
    assert spark.read.format("statestore").load(str(tmp_path / "cp")).count() <= 6
    show = lambda df: sorted((str(r["patient_id"]), str(r["analyte"]), r["n"], r["alarm"], r["score"], r["causal_z"], r["pct_delta"], r["triggers"]) for r in df.collect())
    got, want = show(jobs.last_word(spark.read.parquet(str(tmp_path / "out")))), show(series.monitor(everything))
    assert len(got) == len(want) == 22
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4), (a, b)
