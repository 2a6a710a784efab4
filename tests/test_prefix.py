"""Prefix sums over ranges, and the metrics made of them, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import metrics
from seriesmill.operators.prefix import running


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def table(seed=1, n=600):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([0.5, rng.random(), rng.random()]), rng.random() < 0.4, i, rng.randint(0, 5)) for i in range(n)]


def test_sums_before_each_row(many_ranges):
    rows = table()
    df = many_ranges.createDataFrame(rows, "k string, s double, y boolean, i long, x long").repartition(5)
    for order, key, reverse in (([F.col("s"), F.col("i")], lambda r: (r[1], r[3]), False), ([F.desc("s"), F.desc("i")], lambda r: (r[1], r[3]), True)):
        got = {r["i"]: (r["x_before"], r["one_before"]) for r in running(df.withColumn("one", F.lit(1)), order, ["x", "one"], ["k"]).collect()}
        sums: dict = {}
        for r in sorted(rows, key=key, reverse=reverse):
            assert got[r[3]] == tuple(sums.get(r[0], (0, 0)))
            x, n = sums.get(r[0], (0, 0))
            sums[r[0]] = (x + r[4], n + 1)


def auc(rows):
    p, q = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    return sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)) if p and q else 0.5


def test_areas(many_ranges):
    rows = table(2)
    df = many_ranges.createDataFrame(rows, "k string, s double, y boolean, i long, x long")
    assert metrics.roc_auc(df, F.col("y"), "s").first()["auc"] == pytest.approx(auc(rows), abs=1e-6)
    by = {r["k"]: r["auc"] for r in metrics.roc_auc(df, F.col("y"), "s", ["k"]).collect()}
    assert by == {k: pytest.approx(auc([r for r in rows if r[0] == k]), abs=1e-6) for k in ("a", "b", None)}
    assert metrics.roc_auc(df.filter("y"), F.col("y"), "s").first()["auc"] == 0.5
    area, tp, n, before = 0.0, 0, 0, (0.0, 1.0)
    total = sum(r[2] for r in rows)
    for s in sorted({r[1] for r in rows}, reverse=True):
        own = [r for r in rows if r[1] == s]
        tp, n = tp + sum(r[2] for r in own), n + len(own)
        area += (tp / total - before[0]) * (tp / n + before[1]) / 2
        before = (tp / total, tp / n)
    assert metrics.pr_auc(df, F.col("y"), "s").first()["pr_auc"] == pytest.approx(area, abs=1e-6)


@pytest.mark.parametrize("n", [0, 1, 3, 5, 23, 100])
def test_residual_calibration_by_equal_counts(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([1.0, 2.0, rng.random()]), rng.random()) for i in range(n)]
    got = metrics.residual_calibration(spark.createDataFrame([*rows, (1000, None, 1.0), (1001, 1.0, None)], "i long, g double, y double"), "y", "g", "i").first()
    rows.sort(key=lambda r: (r[1], r[0]))
    sizes = [n // 5 + (b < n % 5) for b in range(5)]
    bins, at = [], 0
    for size in sizes:
        if size:
            bins.append(abs(sum(y - g for _, g, y in rows[at : at + size]) / size))
        at += size
    assert (got["residual_error"], got["bins"]) == (pytest.approx(sum(bins) / len(bins) if bins else 0.0, abs=1e-6), len(bins))


def test_rank_correlation_with_ties(many_ranges):
    rows = table(3, 200)
    df = many_ranges.createDataFrame(rows, "k string, s double, y boolean, i long, x long")
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["k", "s", "y", "i", "x"])
    assert metrics.rank_stability(df, "s", "x").first()["rho"] == pytest.approx(pdf["s"].rank().corr(pdf["x"].rank()), abs=1e-6)
