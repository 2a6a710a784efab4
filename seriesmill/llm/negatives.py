"""Hard negatives by cover trees over norm-augmented candidates.

A candidate x gets one more component, sqrt(M^2 - |x|^2), with M the largest norm, so all candidates lie on a sphere and the
distance to a query (with 0 there) tells the inner product. Candidates are dealt by label group and nearest top
centre into blocks of bounded size; each block is a cover tree whose nodes keep the largest distance of what they cover, level by
level. That radius bounds the inner products below a node from both sides. A search goes down best bound first,
leaves out nodes outside of its window or below the worst result it still needs, and computes the leaves' products
exactly, in integers. Searches of one batch go down together in numpy; batches are of bounded bytes and broadcast, and
what they need is first bounded by a pass over a few of the blocks, so that the others send little.

Equal candidates (same vector and label) are one point with its first ids, and equal anchors one query, so neither a common
vector nor its anchors multiply any work; results go back to all anchors by a join that splits hot keys.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; components past
+-2^20 after the multiplication count as that; shorter vectors are filled with zeros; ids may repeat (each row counts) or be null
(never an anchor, last among ties); a positive whose score is negative has no window; empty tables give an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle
from .skew import salted

SCALE, LARGEST = 256, 1 << 20
ANCHORS, MOVED, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Points of a block and of a leaf; factor between the radii of two levels.
BLOCK, LEAF, BASE = 2048, 24, 1.3
#: Label groups; most top centres, and the candidates they are chosen from; one block in PILOT is searched first.
GROUPS, CENTRES, SAMPLE, PILOT = 64, 256, 4096, 16
#: Bytes of the vectors of a batch of queries, and queries that go down a tree together.
BATCH, TOGETHER = 32 << 20, 1024


# --- the tree ---
class CoverTree:
    """Points (integers, n x d) with M^2; nodes in order of level: centre, radius, the range of ``order`` they cover, and their
    children's range (none: a leaf)."""

    def __init__(self, points: np.ndarray, most: float):
        self.points, self.most = points, most
        full = np.column_stack([points.astype(np.float64), np.sqrt(np.maximum(most - (points.astype(np.float64) ** 2).sum(1), 0))])
        order, nodes = np.arange(len(points)), []
        far = np.sqrt(((full - full[0]) ** 2).sum(1)) if len(points) else np.zeros(0)
        level = [(0, float(far.max(initial=0.0)), 0, len(points))]
        while level:
            at, below = len(nodes) + len(level), []
            for centre, radius, low, high in level:
                parts = self._split(full[order[low:high]], centre, order[low:high], radius) if high - low > LEAF and radius > 0 else []
                nodes.append((centre, radius, low, high, at + len(below), at + len(below) + len(parts)))
                for c, r, members in parts:
                    order[low : low + len(members)] = members
                    below.append((c, r, low, low + len(members)))
                    low += len(members)
            level = below
        self.order = order
        self.nodes = np.array(nodes, np.float64).reshape(-1, 6)

    @staticmethod
    def _split(full: np.ndarray, centre: int, own: np.ndarray, radius: float) -> list[tuple[int, float, np.ndarray]]:
        """Children that cover the points within the next smaller radius, their centres further apart than that; the node's
        own centre is one of them. None, if they would hold two points or fewer each."""
        square = (full * full).sum(1)
        gram = full @ full.T
        gap = np.sqrt(np.maximum(square[:, None] + square - 2 * gram, 0))
        centres, next_ = [], int(np.flatnonzero(own == centre)[0])
        near, of = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
        while True:
            closer = gap[next_] < near
            near[closer], of[closer] = gap[next_][closer], len(centres)
            near[next_], of[next_] = 0.0, len(centres)
            centres.append(next_)
            next_ = int(near.argmax())
            if near[next_] <= radius / BASE:
                break
            if 2 * len(centres) >= len(own):
                return []
        return [(int(own[c]), float(near[of == k].max()), own[of == k]) for k, c in enumerate(centres)]


class Wanted:
    """Searches and what they have found so far. Searches of one query stand side by side: ``first[q]`` to ``first[q + 1]``. A
    search wants the ``k`` best rows with low <= score <= high, ties by id, null last."""

    def __init__(self, queries: np.ndarray, labels: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.queries, self.labels, self.first, self.k, self.same = queries.astype(np.float64), labels, first, k, same
        self.low, self.high = low.astype(np.float64).copy(), high.astype(np.float64)
        self.square = (self.queries**2).sum(1)
        self.kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, bool)]
        self.top = np.maximum.reduceat(self.high, first[:-1]) if len(low) else self.high

    def floor(self) -> np.ndarray:
        """For each query the least score that one of its searches still takes."""
        return np.minimum.reduceat(self.low, self.first[:-1]) if len(self.low) else self.low

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, own: np.ndarray) -> None:
        """Rows met by queries."""
        n = self.first[q + 1] - self.first[q]
        row = np.repeat(np.arange(len(q)), n)
        search = self.first[q[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        fits = (score[row] >= self.low[search]) & (score[row] <= self.high[search])
        row, search = row[fits], search[fits]
        fresh = (search, score[row].astype(np.int64), ids[row], no_id[row], own[row])
        kept = [np.concatenate(x) for x in zip(self.kept, fresh, strict=True)]
        by = np.lexsort((kept[2], kept[3], -kept[1], kept[0]))
        kept = [x[by] for x in kept]
        opens = np.flatnonzero(np.concatenate([[True], kept[0][1:] != kept[0][:-1]])) if len(by) else np.zeros(0, np.int64)
        place = np.arange(len(by)) - np.repeat(opens, np.diff(np.append(opens, len(by))))
        full = place == self.k - 1
        self.low[kept[0][full]] = np.maximum(self.low[kept[0][full]], kept[1][full])
        self.kept = [x[place < self.k] for x in kept]


def go_down(tree: dict, wanted: Wanted, queries: np.ndarray) -> None:
    """All these queries down one block's tree, best bound first; each round takes twice as many nodes a query as the last."""
    points, nodes, most, labels = tree["points"], tree["nodes"], float(tree["most"]), tree["labels"]
    centre, radius, low, high, child, child_end = nodes[:, 0].astype(int), nodes[:, 1], *(nodes[:, k].astype(int) for k in range(2, 6))
    full, square = points.astype(np.float64), (points.astype(np.int64) ** 2).sum(1)
    slack = 1e-7 * (1 + most)

    def bounds(q: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The largest product below the node, or nothing if all lie above the windows."""
        product = np.empty(len(q))
        for a in range(0, len(q), 50_000):
            product[a : a + 50_000] = np.einsum("ij,ij->i", wanted.queries[q[a : a + 50_000]], full[centre[node[a : a + 50_000]]])
        norm, r = wanted.square[q], radius[node]
        gap = np.sqrt(np.maximum(norm + most - 2 * product, 0))
        upper = np.minimum(product + np.sqrt(norm) * r, (norm + most - np.maximum(gap - r, 0) ** 2) / 2) + slack
        lower = np.maximum(product - np.sqrt(norm) * r, (norm + most - (gap + r) ** 2) / 2) - slack
        return np.where(lower <= wanted.top[q], upper, -np.inf)

    q = queries
    node = np.zeros(len(q), np.int64)
    upper, width = bounds(q, node), 1
    while len(q):
        floor = wanted.floor()
        good = upper >= floor[q]
        q, node, upper = q[good], node[good], upper[good]
        if not len(q):
            break
        by = np.lexsort((-upper, q))
        q, node, upper = q[by], node[by], upper[by]
        opens = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        taken = np.arange(len(q)) - np.repeat(opens, np.diff(np.append(opens, len(q)))) < width
        width *= 2
        own, at = q[taken], node[taken]
        q, node, upper = q[~taken], node[~taken], upper[~taken]
        leaf = child_end[at] == child[at]
        n = child_end[at[~leaf]] - child[at[~leaf]]
        below_q = np.repeat(own[~leaf], n)
        below = np.repeat(child[at[~leaf]], n) + np.arange(len(below_q)) - np.repeat(np.cumsum(n) - n, n)
        q, node, upper = np.concatenate([q, below_q]), np.concatenate([node, below]), np.concatenate([upper, bounds(below_q, below)])
        met = []
        by = np.argsort(at[leaf], kind="stable")
        leaf_q, leaf_at = own[leaf][by], at[leaf][by]
        for some in np.split(np.arange(len(by)), np.flatnonzero(np.diff(leaf_at)) + 1) if len(by) else ():
            members = tree["order"][low[leaf_at[some[0]]] : high[leaf_at[some[0]]]]
            who = leaf_q[some]
            score = wanted.queries[who] @ full[members].T
            fits = (score >= floor[who][:, None]) & (score <= wanted.top[who][:, None]) & ((wanted.labels[who][:, None] == labels[members]) == wanted.same)
            a, b = np.nonzero(fits)
            met.append((who[a], members[b], score[a, b]))
        if met:
            who, point, score = (np.concatenate(x) for x in zip(*met, strict=True))
            n = tree["id_at"][point + 1] - tree["id_at"][point]
            row = np.repeat(np.arange(len(who)), n)
            place = tree["id_at"][point[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            equal = square[point] + wanted.square[who] - 2 * score == 0
            wanted.add(who[row], score[row], tree["ids"][place], tree["no_id"][place], equal[row])


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


# --- on Spark ---
def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, q: rows that take part, with their own labels moved and their components as integers."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").filter(F.col("label").isNotNull() & x.isNotNull() & whole)
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    q = F.transform(x, lambda c: F.floor(F.least(F.greatest(SCALE * c.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return rows.select("vec_id", label.alias("label"), q.alias("q"))


def points_of(rows: DataFrame) -> DataFrame:
    """label, q, ids: each distinct candidate with the first ids, which alone can be among the results. Spark keeps only so
    many rows of a key before it shuffles."""
    most = max(POSITIVES + 1, NEGATIVES)
    w = Window.partitionBy("label", "q").orderBy(F.col("vec_id").asc_nulls_last())
    first = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return first.groupBy("label", "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda s: s["vec_id"]).alias("ids"))


def plant(points: DataFrame) -> DataFrame:
    """The settled points as a forest: a row for each block with its packed tree."""
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c)
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int")
    n, width, most, groups = points.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(norm), F.count_distinct(group)).first()
    width, most = max(width or 0, 1), float(most or 0)
    some = points.select("q", "label").orderBy(F.xxhash64("q"), "label").limit(SAMPLE).toPandas()
    cells = min(CENTRES, max(1, -(-n // (BLOCK * max(groups, 1)))))
    sample = CoverTree(_matrix(some["q"], width), most)
    centres = _top_centres(sample, cells)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.column_stack([centres, np.sqrt(np.maximum(most - (centres**2).sum(1), 0))])
        for b in batches:
            own = _matrix(b["q"], width).astype(np.float64)
            product = own @ full[:, :-1].T + np.sqrt(np.maximum(most - (own**2).sum(1), 0))[:, None] * full[:, -1]
            yield b.assign(cell=product.argmax(1).astype(np.int32) if len(b) else np.zeros(0, np.int32))

    dealt = settle(points.withColumn("tribe", group).mapInPandas(nearest, "label long, q array<int>, ids array<long>, tribe int, cell int"), "negatives-cells")
    parts = dealt.groupBy("tribe", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))  # GROUPS x CENTRES rows at most
    blocks = dealt.join(F.broadcast(parts), ["tribe", "cell"]).withColumn("part", F.pmod(F.xxhash64("q", "label"), F.col("parts")))

    def grow(of: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(_matrix(of["q"], width), most)
        ids = [i for own in of["ids"] for i in own]
        no_id = np.array([i is None or i != i for i in ids], bool)
        held = np.array([0 if gone else int(i) for i, gone in zip(ids, no_id, strict=True)], np.int64)
        id_at = np.concatenate([[0], np.cumsum([len(i) for i in of["ids"]])])
        packed = _pack(points=tree.points.astype(np.int32), nodes=tree.nodes, order=tree.order, most=np.array(most), labels=of["label"].to_numpy(), ids=held, no_id=no_id, id_at=id_at)
        return pd.DataFrame({"block": [hash((int(of["tribe"].iloc[0]), int(of["cell"].iloc[0]), int(of["part"].iloc[0]))) & 0x7FFFFFFF], "tree": [packed]})

    forest = settle(blocks.groupBy("tribe", "cell", "part").applyInPandas(grow, "block long, tree binary"), "negatives-forest")
    forget(dealt)
    return forest


def _top_centres(tree: CoverTree, most: int) -> np.ndarray:
    """The centres of the sample's tree, level by level, as far as there are ``most``."""
    found = list(dict.fromkeys([*tree.nodes[:, 0].astype(int).tolist(), *tree.order.tolist()]))[:most] if len(tree.points) else []
    return tree.points[found].astype(np.float64) if found else np.zeros((1, tree.points.shape[1]))


def search(forest: DataFrame, wanted: DataFrame, k: int, same: bool) -> DataFrame:
    """wanted (qid, label, q, search, low, high), settled -> qid, search, score, id, own: of each search the ``k`` best rows of its own
    label (or of others); ``own``: with the query's vector."""
    spark = forest.sparkSession
    schema = "qid long, search long, score long, id long, own boolean"
    width = wanted.agg(F.max(F.size("q")), F.count_distinct("qid")).first()
    batches = max(1, -(-(width[1] * 8 * max(width[0] or 0, 1)) // BATCH))
    number = F.pmod(F.xxhash64("qid"), F.lit(batches))
    of_search = Window.partitionBy("qid", "search").orderBy(F.desc("score"), F.col("id").asc_nulls_last())

    def run(own_blocks: DataFrame, batch: pd.DataFrame) -> DataFrame:
        batch = batch.sort_values(["qid", "search"], ignore_index=True)
        opens = np.flatnonzero(np.concatenate([[True], np.diff(batch["qid"].to_numpy()) != 0])) if len(batch) else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast(
            {"q": batch["q"].iloc[opens].tolist(), "labels": batch["label"].to_numpy()[opens], "first": np.append(opens, len(batch)), "low": batch["low"].to_numpy(), "high": batch["high"].to_numpy(), "qid": batch["qid"].to_numpy(), "search": batch["search"].to_numpy()}
        )

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, own = sent.value, None
            for frame in frames:
                for data in frame["tree"]:
                    tree = _unpack(data)
                    if own is None:  # once a task
                        own = Wanted(_matrix(held["q"], tree["points"].shape[1]), held["labels"], held["first"], held["low"], held["high"], k, same)
                    there = np.unique(tree["labels"])
                    asks = np.isin(own.labels, there) if same else (np.ones(len(own.labels), bool) if len(there) > 1 else own.labels != there[0])
                    asks = np.flatnonzero(asks)
                    for a in range(0, len(asks), TOGETHER):
                        go_down(tree, own, asks[a : a + TOGETHER])
            if own is not None:
                at, score, ids, no_id, equal = own.kept
                yield pd.DataFrame({"qid": held["qid"][at], "search": held["search"][at], "score": score, "id": pd.arrays.IntegerArray(ids, no_id), "own": equal})

        return own_blocks.select("tree").mapInPandas(task, schema)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(of_search)).filter(F.col("place") <= k)

    pilot = F.col("block") % PILOT == 0
    out = None
    for b in range(batches):  # of bounded bytes each
        batch = wanted.filter(number == b)
        first = settle(best(run(forest.filter(pilot), batch.toPandas())).drop("place"), "negatives-pilot")
        # what a search has k times bounds what it takes from the other blocks
        least = first.groupBy("qid", "search").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        bound = F.when(F.col("least") > F.col("low"), F.col("least")).otherwise(F.col("low"))
        raised = batch.join(least, ["qid", "search"], "left").select("qid", "label", "q", "search", bound.alias("low"), "high")
        found = first.union(run(forest.filter(~pilot), raised.toPandas()))
        found = settle(best(found), "negatives-found")
        forget(first)
        out = found if out is None else out.union(found)
    return out


def mine(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = taking_part(embeddings)
    anchors = rows.filter(F.col("vec_id") % ANCHORS == 0)
    points = settle(points_of(rows), "negatives-points")
    forest = plant(points)
    queries = settle(anchors.select("label", "q").distinct().withColumn("qid", F.monotonically_increasing_id()), "negatives-queries")
    every = F.lit(float("inf"))
    asked = settle(queries.select("qid", "label", "q", F.lit(0).cast("long").alias("search"), (-every).alias("low"), every.alias("high")), "negatives-asked")
    positive = settle(search(forest, asked, POSITIVES + 1, True), "negatives-positive")
    # rounded up and down in integers; a score below zero has no window
    low, high = F.expr(f"(score * {LOW} + 99) div 100"), F.expr(f"(score * {HIGH}) div 100")
    windows = positive.filter("score >= 0").select("qid", "score").distinct().select("qid", F.col("score").alias("search"), low.cast("double").alias("low"), high.cast("double").alias("high")).filter("low <= high")
    windows = settle(windows.join(queries, "qid").select("qid", "label", "q", "search", "low", "high"), "negatives-windows")
    negative = search(forest, windows, NEGATIVES, False)
    ranked = lambda *c: F.array_sort(F.collect_list(F.struct("place", *c)))
    of_window = negative.groupBy("qid", "search").agg(ranked("id", "score").alias("rows"))
    of_query = of_window.groupBy("qid").agg(F.collect_list(F.struct("search", "rows")).alias("windows"))
    known = queries.join(positive.groupBy("qid").agg(ranked("id", "score", "own").alias("positives")), "qid").join(of_query, "qid")
    known = settle(known.select("label", "q", "positives", "windows"), "negatives-known")
    forget(points, forest, asked, positive, windows)
    met = salted(settle(anchors, "negatives-anchors"), known, ("label", "q"), "vec_id")
    self_ = F.array_position(F.transform("positives", lambda p: p["own"] & F.coalesce(p["id"] == F.col("vec_id"), F.lit(False))), True).cast("int")
    others = F.when(self_ > 0, F.concat(F.slice("positives", F.lit(1), self_ - 1), F.slice("positives", self_ + 1, F.size("positives")))).otherwise(F.col("positives"))
    pairs = met.select("vec_id", "windows", F.explode(F.slice(others, 1, POSITIVES)).alias("p"))
    of_pair = F.element_at(F.filter("windows", lambda w: w["search"] == F.col("p.score")), 1)
    rows_ = pairs.filter(F.exists("windows", lambda w: w["search"] == F.col("p.score"))).select("vec_id", "p", F.explode(of_pair["rows"]).alias("n"))
    return rows_.select(
        F.col("vec_id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("n.place").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


SQL = """
with part as (
  select row_number() over () as row_, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), products as (
  select a.row_ as a, a.vec_id as anchor_id, a.label as anchor_label, b.row_ as b, b.vec_id, b.label, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::bigint as score
  from part a join part b on a.row_ <> b.row_ where a.vec_id % 100 = 0
), positives as (
  select * from products where label = anchor_label qualify row_number() over (partition by a order by score desc, vec_id, b) <= 5
), ranked as (
  select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.b order by n.score desc, n.vec_id, n.b) as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
  from positives p join products n on n.a = p.a and n.label <> p.anchor_label and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 10
"""
