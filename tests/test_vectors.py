"""The index of cells against brute force."""

import numpy as np
import pytest

from seriesmill.operators import models, vectors


def clouds(n, groups, width=8, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    return (middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def frame(spark, v, more=()):
    return spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), *more], "vec_id long, embedding array<float>").repartition(3)


def nearest(rows, k):
    ids = [i for i, _ in rows]
    v = np.array([x for _, x in rows], np.float32).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    s = np.round(v @ v.T, 6)
    return {ids[a]: [ids[b] for b in sorted((b for b in range(len(ids)) if ids[b] != ids[a]), key=lambda b: (-s[a, b], ids[b]))[:k]] for a in range(len(ids))}


def answers(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_all_cells_give_brute_force_with_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 50)
    monkeypatch.setattr(vectors, "TOGETHER", 60)
    v = clouds(300, 9)
    copies = [(1000 + i, v[0].tolist()) for i in range(150)]
    odd = [(5000, None), (5001, [0.1, None] + [0.0] * 6), (5002, [float("nan")] * 8)]
    df = frame(spark, v, [*copies, *odd])
    index = vectors.build_index(df, cells=7, probes=7)
    want = nearest([*((i, x.tolist()) for i, x in enumerate(v)), *copies], 5)
    assert answers(index.search(df, 5)) == want
    with pytest.raises(ValueError):
        index.search(df, 64)


def test_measured_cells_hold_the_wanted_share(spark):
    df = frame(spark, clouds(3000, 30, width=16))
    index = vectors.build_index(df, recall=0.9, k=5, cells=40)
    assert index.probes <= 8 and index.recall >= 0.9
    got = vectors.recall_of(index, df.filter("vec_id % 10 = 0"), 5).first()
    assert got["wanted"] == 1500 and got["recall"] >= 0.85


def test_outlier_factor_through_the_index(spark):
    df = frame(spark, clouds(200, 4), [(900, [5.0, -9.0, 3.0, 0.0, 0.0, 1.0, -2.0, 8.0])])
    exact = {r["vec_id"]: r["lof"] for r in models.local_outlier_factor(df, 5).collect()}
    index = vectors.build_index(df, cells=4, probes=4)
    got = {r["vec_id"]: r["lof"] for r in models.local_outlier_factor(df, 5, index).collect()}
    assert got == {i: pytest.approx(x, abs=2e-3) for i, x in exact.items()}


def test_no_vectors(spark):
    df = frame(spark, [])
    assert vectors.build_index(df).search(df, 3).count() == 0


def test_products_and_dealt_rows_are_held_in_blocks(spark, monkeypatch):
    v = clouds(200, 5)
    df = frame(spark, v)
    monkeypatch.setattr(vectors, "BLOCK", 300)
    monkeypatch.setattr(vectors, "ROWS", 16)
    sizes = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: sizes.extend(len(x) for x in f(iter([self.toPandas()]))) or self)
    unit = df.selectExpr("vec_id as i", "embedding as e")
    vectors._by_cells(unit, np.eye(8)[:4], 4)
    assert sum(sizes) == 800 and max(sizes) <= 16
    monkeypatch.undo()
    monkeypatch.setattr(vectors, "BLOCK", 300)
    monkeypatch.setattr(vectors, "ROWS", 16)
    index = vectors.build_index(df, cells=6, probes=6)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert answers(index.search(df, 5)) == nearest(rows, 5)
