"""The next value of each series by a regression per measure on what its earlier readings looked like."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import series

#: What a prediction is made from; the horizon is the days to the value told.
FEATURES = ("value", "horizon", "n", "span", "lag1", "lag2", "lag3", "mean3", "std3", "mean_all", "delta", "slope")


def _features(rows: DataFrame, v: str, horizon: Column) -> DataFrame:
    """Rows of ``series.lag_features`` with all of ``FEATURES``: what a short series lacks is its oldest value known."""
    older = F.coalesce("lag1", v), F.coalesce("lag2", "lag1", v), F.coalesce("lag3", "lag2", "lag1", v)
    filled = rows.withColumns({"horizon": horizon.cast("double"), "lag1": older[0], "lag2": older[1], "lag3": older[2], "value_": F.col(v).cast("double")})
    return filled.withColumns({"value": F.col("value_"), "n": F.col("n").cast("double"), "delta": F.coalesce("delta", F.lit(0.0)), "std3": F.coalesce("std3", F.lit(0.0))})


def trend(now: Column, then: Column, eps: float = 0.02) -> Column:
    """increasing, decreasing, or stable: by less than ``eps`` of the value and of a twentieth of it (at least of 1, and 0.05)."""
    step = then - now
    still = (F.abs(step) / F.greatest(F.abs(now), F.lit(1e-6)) < eps) & (F.abs(step) < F.greatest(0.05 * F.greatest(F.abs(now), F.lit(1.0)), F.lit(0.05)))
    return F.when(now.isNull() | then.isNull(), "unknown").when(still, "stable").when(step > 0, "increasing").otherwise("decreasing")


class SeriesForecast:
    """fit(observations) learns from each prefix of a series and the value that came at least a day later; transform tells the value
    ``horizon_days`` after each series' last. The model is a table: measure, rows, weights, intercept, residual_std.

    The regression is ridge on standardised features, solved from each measure's counts, means and covariances, which Spark adds up
    in one pass; so a measure costs the driver nothing, and only numbers of fixed size meet in a task."""

    def __init__(self, measure: str = "analyte", keys: Sequence[str] = series.KEYS, v: str = "value", ridge: float = 1.0, min_points: int = 2, least_rows: int = 5, z: float = 1.645):
        self.measure, self.keys, self.v, self.ridge, self.min_points, self.least_rows, self.z = measure, list(keys), v, ridge, min_points, least_rows, z
        self.models: DataFrame | None = None

    def training_rows(self, df: DataFrame) -> DataFrame:
        rows = series.supervised_rows(df, self.min_points, self.keys, self.v)
        return _features(rows, self.v, F.col("gap_days")).select(self.measure, *FEATURES, F.col("next_value").cast("double").alias("y"))

    def fit(self, df: DataFrame) -> SeriesForecast:
        names, measure, ridge = [*FEATURES, "y"], self.measure, self.ridge
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
        means = F.array(*(F.avg(a) for a in names)).alias("means")
        sums = self.training_rows(df).groupBy(measure).agg(F.count(F.lit(1)).alias("rows"), means, F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("moments"))
        kind = sums.schema[measure].dataType.simpleString()

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            k = len(FEATURES)
            upper = np.triu_indices(k + 1)
            for b in batches:
                out = []
                for name, n, mean, moment in zip(b[measure], b["rows"], b["means"], b["moments"], strict=True):
                    c = np.zeros((k + 1, k + 1))
                    c[upper] = moment
                    c += np.triu(c, 1).T
                    scale = np.sqrt(np.maximum(np.diag(c)[:k], 0.0))
                    scale[scale < 1e-12] = 1.0
                    w = np.linalg.solve(n * c[:k, :k] / np.outer(scale, scale) + ridge * np.eye(k), n * c[:k, k] / scale) / scale
                    left = max(float(c[k, k] - 2 * w @ c[:k, k] + w @ c[:k, :k] @ w), 0.0)
                    out.append((name, n, w, float(mean[k] - w @ np.asarray(mean[:k])), max(left**0.5, 1e-3)))
                yield pd.DataFrame(out, columns=[measure, "rows", "weights", "intercept", "residual_std"])

        self.models = sums.filter(F.col("rows") >= self.least_rows).mapInPandas(solve, f"`{measure}` {kind}, rows long, weights array<double>, intercept double, residual_std double")
        return self

    def transform(self, df: DataFrame, horizon_days: float) -> DataFrame:
        """keys, n, current, predicted, low, high, confidence, trend, method. Series with fewer than ``min_points`` values, or of a
        measure without a model, go on as they are, with little confidence."""
        rows = _features(series.lag_features(df, self.keys, self.v), self.v, F.lit(float(horizon_days)))
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*FEATURES), F.struct("ts", "evidence_id")).alias("x")).select(*self.keys, "x")
        both = last.join(self.models, self.measure, "left")
        told = F.aggregate(F.zip_with(F.array(*(F.col(f"x.{f}") for f in FEATURES)), "weights", lambda a, w: a * w), F.col("intercept"), lambda s, p: s + p)
        now, n = F.col("x.value"), F.col("x.n")
        known = (n >= self.min_points) & F.col("weights").isNotNull()
        std = F.coalesce("residual_std", F.abs(now) * 0.1 + 0.1)
        both = both.withColumns({"predicted": F.when(known, told).otherwise(now), "std": std})
        sure = F.least(F.lit(0.98), F.greatest(F.lit(0.4), 0.55 + 0.08 * F.least(n, F.lit(5.0)) - 0.15 * (F.col("std") / (F.abs("predicted") + 1e-3))))
        r = lambda c, name: F.round(c, 6).alias(name)
        return both.select(
            *self.keys, n.cast("long").alias("n"), now.alias("current"), r(F.col("predicted"), "predicted"), r(F.col("predicted") - self.z * F.col("std"), "low"), r(F.col("predicted") + self.z * F.col("std"), "high"),
            r(F.when(known, sure).otherwise(0.35), "confidence"), trend(now, F.col("predicted")).alias("trend"), F.when(known, "regression").otherwise("persistence").alias("method"),
        )
