"""Hard negatives against brute force; the tree's radii and what it leaves out."""

import math
import random

import numpy as np
import pytest

from seriesmill.llm import negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def expected(rows):
    part = []
    for i, v, label, *_ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(min(max(256 * float(np.float32(x)), -(2**20)), 2**20)) for x in v]
        part.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, label, q) in enumerate(part):
        if i is None or i % 100:
            continue
        every = [(dot(q, r), k, m) for b, (k, m, r) in enumerate(part) if a != b]
        for score, positive, _ in sorted((s for s in every if s[2] == label), key=key)[:5]:
            fits = sorted((s for s in every if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=key)[:10]
            out += [(i, positive, rank + 1, k, score, s) for rank, (s, k, _) in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows):
    got = hn.mine(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def clouds(seed, n, width=6, labels=4, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, width))
    label = rng.integers(0, labels, n)
    return (middle[label] * 0.2 + 0.3 + spread * rng.normal(size=(n, width))).astype(np.float32), label


def odd_rows():
    rng = random.Random(3)
    vectors, labels = clouds(1, 700)
    rows = [(5 * i, v.tolist(), int(c), "x") for i, (v, c) in enumerate(zip(vectors, labels, strict=True))]
    hot = vectors[0].tolist()
    rows += [(10_000 + i, hot, rng.choice([0, 1, 2]), "x") for i in range(400)]  # a third of all, anchors among them
    rows += [rows[20], rows[20], (100, vectors[9].tolist(), 1, "x"), (None, hot, 1, "x"), (None, vectors[3].tolist(), 2, "x")]
    rows += [(7001, None, 1, "x"), (7003, [0.1, None], 1, "x"), (7100, [float("nan")] * 6, 1, "x"), (7200, [float("inf")] * 6, 1, "x"), (7300, hot, None, "x")]
    rows += [(8000, [], 1, "x"), (8001, [0.5], 1, "x"), (8002, [0.1] * 9, 2, "x"), (8003, [0.0] * 6, 3, "x"), (8100, [-1.0] * 6, 3, "x"), (8101, [1e30, -1e30], 2, "x"), (8200, [1e30], 77, "x"), (8203, [1e29], 77, "x")]
    return rows


@pytest.mark.parametrize(("block", "pilot", "batch"), [(hn.BLOCK, hn.PILOT, hn.BATCH), (40, 3, 400)])
def test_rows_are_those_of_brute_force(spark, monkeypatch, block, pilot, batch):
    """Also with many blocks, parts and batches."""
    for name, value in (("BLOCK", block), ("PILOT", pilot), ("BATCH", batch)):
        monkeypatch.setattr(hn, name, value)
    rows = odd_rows()
    want = expected(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want


def test_many_labels_and_single_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)], i // 3 % 90, "x") for i in range(600)]
    assert mined(spark, rows) == expected(rows)
    assert mined(spark, [(100, [0.5, 0.5], 1, "x")]) == []


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, None, 1, "x"), (200, [0.1], None, "x")]) == []


@pytest.mark.parametrize("seed", range(4))
def test_radii_cover_and_centres_keep_apart(seed):
    v, _ = clouds(seed, 500, spread=0.05)
    points = np.floor(256 * v).astype(np.int64)
    most = float((points**2).sum(1).max())
    tree = hn.CoverTree(points, most)
    full = np.column_stack([points, np.sqrt(most - (points**2).sum(1))])
    assert sorted(tree.order.tolist()) == list(range(500))
    assert len(tree.nodes) > 10
    for centre, radius, low, high, child, end in tree.nodes:
        members = tree.order[int(low) : int(high)]
        assert np.sqrt(((full[members] - full[int(centre)]) ** 2).sum(1)).max() <= radius + 1e-6
        below = tree.nodes[int(child) : int(end)]
        if len(below):
            assert below[0, 0] == centre and below[0, 2] == low and below[-1, 3] == high
            assert (below[1:, 2] == below[:-1, 3]).all()
            assert (below[:, 1] <= radius / hn.BASE + 1e-6).all()
            centres = full[below[:, 0].astype(int)]
            gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(2)) + 1e9 * np.eye(len(below))
            assert gaps.min() > radius / hn.BASE - 1e-6


def test_nodes_outside_of_windows_are_left_out(monkeypatch):
    v, label = clouds(9, 2000, spread=0.02)
    points = np.floor(256 * v).astype(np.int64)
    most = float((points**2).sum(1).max())
    tree = hn.CoverTree(points, most)
    held = {"points": points, "nodes": tree.nodes, "order": tree.order, "most": np.array(most), "labels": label, "ids": np.arange(2000), "no_id": np.zeros(2000, bool), "id_at": np.arange(2001)}
    queries = points[:20]
    products = queries @ points.T
    high = np.percentile(products, 60, axis=1)
    wanted = hn.Wanted(queries, label[:20], np.arange(21), np.percentile(products, 40, axis=1), high, 10, False)
    seen, add = [], wanted.add
    monkeypatch.setattr(wanted, "add", lambda q, *rest: (seen.append(len(q)), add(q, *rest)))
    hn.go_down(held, wanted, np.arange(20))
    for q in range(20):
        own = sorted((-s, i) for i, s in enumerate(products[q]) if label[i] != label[q] and s <= high[q] and s >= np.percentile(products[q], 40))[:10]
        assert [(-int(s), int(i)) for w, s, i, *_ in zip(*wanted.kept, strict=True) if w == q] == own
    assert sum(seen) < 20 * 2000 / 4
