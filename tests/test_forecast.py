"""The forecast against a direct fit, and its rules on short and unknown series."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import forecast

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "patient_id string, analyte string, ts timestamp_ntz, value double, evidence_id long"


def rows():
    rng, out = random.Random(4), []
    for p in range(12):
        for m, slope in (("up", 5.0), ("flat", 0.0)):
            level = rng.uniform(80, 120)
            out += [(f"p{p}", m, T0 + datetime.timedelta(days=3 * j + rng.random()), level + slope * 3 * j + rng.gauss(0, 0.5), len(out) + j) for j in range(rng.randint(4, 14))]
    out += [("solo", "up", T0, 50.0, 9001), ("new", "rare", T0, 7.0, 9002), ("new", "rare", T0 + datetime.timedelta(days=2), 9.0, 9003), ("none", "up", T0, None, 9004)]
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()
    return df, forecast.SeriesForecast().fit(df)


def test_weights_are_those_of_a_direct_fit(fitted):
    df, model = fitted
    got = {r["analyte"]: r for r in model.models.collect()}
    assert set(got) == {"up", "flat"}
    train = model.training_rows(df).toPandas()
    for m, own in train.groupby("analyte"):
        if m == "rare":
            continue
        x, y = own[list(forecast.FEATURES)].to_numpy(float), own["y"].to_numpy(float)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-12] = 1.0
        z = (x - mean) / scale
        w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
        assert got[m]["weights"] == pytest.approx(w / scale, abs=1e-6) and got[m]["rows"] == len(own)
        left = y - y.mean() - z @ w
        assert got[m]["residual_std"] == pytest.approx(max(left.std(), 1e-3), rel=1e-4)


def test_predictions_and_their_labels(fitted):
    df, model = fitted
    got = {(r["patient_id"], r["analyte"]): r for r in model.transform(df, 3.0).collect()}
    assert len(got) == 26 and ("none", "up") not in got
    up = [r for (p, m), r in got.items() if m == "up" and p != "solo"]
    assert np.mean([r["predicted"] - r["current"] for r in up]) == pytest.approx(15.0, abs=1.5)
    assert sum(r["trend"] == "increasing" for r in up) >= 10
    assert all(r["low"] < r["predicted"] < r["high"] and 0.4 <= r["confidence"] <= 0.98 and r["method"] == "regression" for r in up)
    solo, rare = got["solo", "up"], got["new", "rare"]
    assert (solo["method"], solo["predicted"], solo["trend"], solo["confidence"]) == ("persistence", 50.0, "stable", 0.35)
    assert (rare["method"], rare["predicted"], rare["n"]) == ("persistence", 9.0, 2)
    assert rare["high"] == pytest.approx(9.0 + 1.645 * 1.0)


@pytest.mark.parametrize(("now", "then", "want"), [(100.0, 101.0, "stable"), (100.0, 103.0, "increasing"), (100.0, 97.0, "decreasing"), (0.0, 0.01, "increasing"), (None, 1.0, "unknown"), (1.0, 1.0, "stable")])
def test_trend(spark, now, then, want):
    assert spark.createDataFrame([(now, then)], "a double, b double").select(forecast.trend(F.col("a"), F.col("b"))).first()[0] == want


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert forecast.SeriesForecast().fit(df).transform(df, 5.0).count() == 0
