"""The index's searches by blocks: what they visit, what they give, and what they don't write."""

import numpy as np
from pyspark.sql import functions as F

from seriesmill.operators import models, vectors


def rows_of(n, width=8, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, width))
    return [(i, (middle[i % 6] + 0.4 * rng.normal(size=width)).astype(np.float32).tolist()) for i in range(n)]


def visited(rows, centres, probes, k):
    """Brute force over the cells that a query visits: (query, id, rank) -> score."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = np.argsort(-(v @ centres.T), axis=1, kind="stable")
    own, s, out = near[:, 0], np.round(v @ v.T, 6), {}
    for a in range(len(ids)):
        b = [x for x in range(len(ids)) if x != a and own[x] in near[a, :probes]]
        for rank, x in enumerate(sorted(b, key=lambda x: (-s[a, x], ids[x]))[:k], 1):  # noqa: B023
            out[int(ids[a]), int(ids[x]), rank] = s[a, x]
    return out


def test_small_blocks_give_what_the_visited_cells_hold(spark, monkeypatch):
    for name, value in {"PART": 20, "TOGETHER": 30, "FEWEST": 7, "SHARE": 2000, "BLOCK": 90, "PENDING": 40, "TASKS": 5}.items():
        monkeypatch.setattr(vectors, name, value)
    rows = rows_of(240)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    index = vectors.build_index(df, cells=9, probes=3)
    assert index.shares > 5 and index.cells.count() > 9
    got = {(r["query_id"], r["vec_id"], r["rank"]): r["score"] for r in index.search(df, 4).collect()}
    want = visited(rows, index.centres, 3, 4)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-6 for x in want)


def test_a_query_is_dealt_once_however_many_cells_it_visits(spark, monkeypatch):
    """Before, a search wrote and shuffled each query once for each cell, and cells grow with the vectors."""
    dealt, by_cells = [], vectors._by_cells
    monkeypatch.setattr(vectors, "_by_cells", lambda df, centres, most: dealt.append(most) or by_cells(df, centres, most))
    df = spark.createDataFrame(rows_of(120), "vec_id long, embedding array<float>")
    index = vectors.build_index(df, cells=10, probes=8)
    found = index._scored(vectors._unit(df).select(F.col("vec_id").alias("i"), "e"), 3, 8)
    assert set(dealt) == {1}
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_probes_are_measured_on_as_many_others_as_asked_for(spark):
    """A query is its own nearest: it isn't one of the k."""
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(np.linspace(0, 6, 60))]
    index = vectors.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), recall=1.0, k=40, cells=6)
    assert index.probes >= 5 and index.recall == 1.0


def test_the_outlier_factor_finds_neighbours_once(spark):
    searched = []

    class Spied:
        def search(self, df, k):
            seen = spark.sparkContext.accumulator(0)
            searched.append(seen)

            def run(batches):
                for b in batches:
                    seen.add(len(b))
                    yield b

            found = models.knn(df, df, k)
            return found.mapInPandas(run, found.schema)

    df = spark.createDataFrame(rows_of(50), "vec_id long, embedding array<float>")
    assert models.local_outlier_factor(df, 5, Spied()).count() == 50
    assert searched[0].value == 250
