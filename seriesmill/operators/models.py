"""Feature-table models: Spark ML estimators, a forecast from grouped normal equations, neighbour and isolation scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from . import series
from .retrieval import knn
from .vectors import VectorIndex


def _prepared(columns: Sequence[str]) -> list:
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw", handleInvalid="keep"), RobustScaler(inputCol="raw", outputCol="features", withCentering=True),
    ]


class RiskModels:
    """One binary classifier per condition, logistic or boosted."""

    def __init__(self, columns: Sequence[str], conditions: Sequence[str], kind: str = "logistic"):
        self.columns, self.conditions, self.kind = list(columns), list(conditions), kind
        self.models: dict[str, PipelineModel] = {}

    def fit(self, df: DataFrame) -> RiskModels:
        make = (lambda c: LogisticRegression(labelCol=c, regParam=0.01)) if self.kind == "logistic" else (lambda c: GBTClassifier(labelCol=c, maxIter=20, seed=7))
        for c in self.conditions:
            self.models[c] = Pipeline(stages=[*_prepared(self.columns), make(c)]).fit(df.filter(F.col(c).isNotNull()))
        return self

    def transform(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = None
        for c, m in self.models.items():
            one = m.transform(df).select(*key, F.lit(c).alias("condition"), F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("probability"))
            out = one if out is None else out.unionByName(one)
        return out


class ScoreModel:
    """Ridge or boosted regression with the deviation of its residuals."""

    def __init__(self, columns: Sequence[str], target: str, kind: str = "ridge"):
        self.columns, self.target, self.kind = list(columns), target, kind

    def fit(self, df: DataFrame) -> ScoreModel:
        last = LinearRegression(labelCol=self.target, regParam=0.1) if self.kind == "ridge" else GBTRegressor(labelCol=self.target, maxIter=20, seed=7)
        self.model = Pipeline(stages=[*_prepared(self.columns), last]).fit(df)
        self.residual_std = self.model.transform(df).agg(F.stddev_pop(F.col(self.target) - F.col("prediction"))).first()[0]
        return self

    def transform(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        return self.model.transform(df).select(*key, F.round("prediction", 6).alias("prediction"), F.lit(self.residual_std).alias("residual_std"))

    def importance(self, k: int) -> list[tuple[str, float]]:
        w = self.model.stages[-1].coefficients.toArray() if self.kind == "ridge" else self.model.stages[-1].featureImportances.toArray()
        return sorted(zip(self.columns, w.tolist(), strict=True), key=lambda x: (-abs(x[1]), x[0]))[:k]

    def importance_table(self, k: int) -> DataFrame:
        """feature, weight: the k features with the largest absolute weight; at most one row a column."""
        rows = [(f, abs(w)) for f, w in self.importance(k)]
        return SparkSession.active().createDataFrame(rows, "feature string, weight double")


def forecast(df: DataFrame, horizon_days: float, z: float = 1.96, least: int = 3, keys: Sequence[str] = series.KEYS, v: str = "value") -> DataFrame:
    """Straight line per series from aggregates alone; short or flat-time series persist. Interval by residual deviation."""
    d = df.filter(F.col(v).isNotNull()).withColumn("x", series.days() - 20000.0)  # near the data: sums of squares keep their digits
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg(v).alias("my"), F.covar_pop("x", v).alias("cxy"), F.var_pop("x").alias("vx"), F.var_pop(v).alias("vy"), F.max("x").alias("last_x"), F.max_by(v, F.struct("ts", "evidence_id")).alias("last")
    )
    line = (F.col("n") >= least) & (F.col("vx") > 1e-9)
    slope = F.when(line, F.col("cxy") / F.col("vx")).otherwise(0.0)
    said = F.when(line, F.col("my") + slope * (F.col("last_x") + horizon_days - F.col("mx"))).otherwise(F.col("last"))
    left = F.sqrt(F.greatest(F.when(line, F.col("vy") - F.col("cxy") * F.col("cxy") / F.col("vx")).otherwise(F.col("vy")), F.lit(0.0)))
    out = g.withColumns({"forecast": said, "sd": left})
    return out.select(*keys, "n", F.round("forecast", 3).alias("forecast"), F.round(F.col("forecast") - z * F.col("sd"), 3).alias("low"), F.round(F.col("forecast") + z * F.col("sd"), 3).alias("high"), F.when(line, "line").otherwise("persistence").alias("method"))


def local_outlier_factor(vectors: DataFrame, k: int = 10, index: VectorIndex | None = None) -> DataFrame:
    """Local outlier factor on cosine distance: the neighbour table once, through ``index`` where there is one (else of all
    pairs), then two joins of it with its own aggregates."""
    n = (index.search(vectors, k) if index else knn(vectors, vectors, k)).select("query_id", "vec_id", F.greatest(1.0 - F.col("score"), F.lit(1e-9)).alias("d"))
    path = scratch(vectors.sparkSession, "neighbours")  # k rows a vector, read several times
    n.write.parquet(path)
    n = vectors.sparkSession.read.schema(n.schema).parquet(path)
    reach = n.groupBy("query_id").agg(F.max("d").alias("kd"))
    wide = n.join(reach.select(F.col("query_id").alias("vec_id"), "kd"), "vec_id").groupBy("query_id").agg((1.0 / F.avg(F.greatest("d", "kd"))).alias("density"))
    near = n.join(wide.select(F.col("query_id").alias("vec_id"), F.col("density").alias("nd")), "vec_id").groupBy("query_id").agg(F.avg("nd").alias("nd"))
    return near.join(wide, "query_id").select(F.col("query_id").alias("vec_id"), F.round(F.col("nd") / F.col("density"), 4).alias("lof"))


def isolation_forest(df: DataFrame, key: str, vector: str, trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """Isolation score. Each tree is grown in its own task on its own bounded sample (rows by least hash for that tree); the
    forest, of fixed size, scores all rows."""
    # a row goes to a tree's sample by hash, at a rate that gives a few times the sample; the least hashes stay. Rows are
    # copied only for the trees that take them
    n = max(df.count(), 1)
    rate = min(1.0, 4.0 * sample / n)
    h = lambda tree: F.pmod(F.xxhash64(key, tree, F.lit(seed)), F.lit(1 << 30))
    taking = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: h(tree) < rate * (1 << 30))
    picked = df.select(key, vector, F.explode(taking).alias("tree")).withColumn("h", h(F.col("tree")))
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("h", key))).filter(F.col("place") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed * 1000 + int(pdf["tree"].iloc[0]))
        x = np.vstack(pdf.sort_values("place")[vector].to_numpy()).astype(float)
        nodes: list[tuple] = []

        def split(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, -1, -1, len(rows)))
            spread = np.ptp(x[rows], axis=0) if len(rows) else np.zeros(x.shape[1])
            if depth < int(np.ceil(np.log2(sample))) and len(rows) > 1 and spread.any():
                f = rng.choice(np.nonzero(spread)[0])
                cut = rng.uniform(x[rows, f].min(), x[rows, f].max())
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if len(low) and len(high):
                    a, b = split(low, depth + 1), split(high, depth + 1)
                    nodes[at] = (int(f), float(cut), a, b, len(rows))
            return at

        split(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "size"]).assign(tree=pdf["tree"].iloc[0], node=range(len(nodes)))

    forest = picked.groupBy("tree").applyInPandas(grow, "feature int, cut double, low int, high int, size int, tree int, node int").toArrow().to_pandas()
    grown = [g.sort_values("node")[["feature", "cut", "low", "high", "size"]].to_numpy() for _, g in forest.groupby("tree")]

    def usual(n):
        n = np.maximum(n, 1)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, depth = np.vstack(batch[vector].to_numpy()).astype(float), np.zeros(len(batch))
            for nodes in grown:
                at, deep = np.zeros(len(x), int), np.zeros(len(x))
                while (inner := nodes[at, 0] >= 0).any():
                    rows = np.nonzero(inner)[0]
                    f = nodes[at[rows], 0].astype(int)
                    low = x[rows, f] <= nodes[at[rows], 1]
                    at[rows] = np.where(low, nodes[at[rows], 2], nodes[at[rows], 3]).astype(int)
                    deep[rows] += 1
                depth += deep + usual(nodes[at, 4])
            out = 2.0 ** (-depth / max(len(grown), 1) / max(float(usual(np.array(min(sample, n)))), 1e-9))
            yield pd.DataFrame({key: batch[key], "score": np.round(out, 6)})

    return df.select(key, vector).mapInPandas(score, f"{key} {dict(df.dtypes)[key]}, score double")
