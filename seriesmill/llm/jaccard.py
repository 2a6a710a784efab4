"""N-gram Jaccard join: exact links between documents whose 4-word shingle sets reach a Jaccard similarity.

1. Rows with equal sets are one node, so exact copies never meet in pairs.
2. A node's shingles are hashed into groups; its group counts are a point. Two linked sets share an element among the
   first n - ceil(0.85 n) + 1 in any common order, so each point stands once for each of these elements, and Spark deals
   points by element. The order puts frequent shingles last; elements of a single node are left out.
3. First each node is held against one leader only, of its elements' least nodes the one it meets most often; what these
   links join needs no more pairs. A large group of near copies so costs one pair per document.
4. A multi-level R-tree over (element, set size, group counts), bulk-loaded in that order, is joined with itself from the
   root down, in each task over the elements it was dealt. A pair of tree nodes is left out if their elements or components
   can't meet, if their sizes are too far apart, or if the summed coordinate minima of their upper corners bound the overlap
   too low. The same tests end on pairs of points.
5. Pairs that survive are bounded once more by finer group counts, then verified on the whole texts. No link between
   different components is missed.

Elements with more than ``CELL`` points are dealt to cells of two chunks each. Keys with many rows on one side of a join are
split over several tasks (``skew.salted``). Frequent shingles and the bits of shared elements steer only the order and what
is sent, not the links, so both are bounded and broadcast.

Defined cases: null and empty texts have an empty set, are linked with nothing and are their own component; a null doc_id
is returned with its count and no component, and takes no part in links; rows of one doc_id with different texts are compared
one by one, and link what each of them links (ids are what components hold); an empty table gives an empty result; doc_id may
have any type that Spark can order; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settle, texts
from .components import components
from .skew import picked, salted

SHINGLE = 4
PERCENT = 85
GROUPS = 128
#: Groups of the counts that bound a pair before its texts are shuffled.
FINE = 1024
FULL = 255
#: Most points in one chunk of an element's cell; children of a tree node; most pairs of vectors compared at once.
CELL, FAN, PAIRS = 4096, 16, 20_000
#: Most frequent shingles whose counts steer the order; how often a task must have met one to name it.
FREQUENT, FREQUENT_FROM = 100_000, 3
#: Shingles that a task counts at a time to find frequent ones.
COUNTED = 4_000_000
#: Bits (as a power of two) of the filter of shared elements.
FILTER_BITS = 27
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = h * _M[k % 3] + w[k : k + n]
    h = (h ^ (h >> np.uint64(30))) * _M[3]
    h = (h ^ (h >> np.uint64(27))) * _M[4]
    return np.unique(h ^ (h >> np.uint64(31)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _slices(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """Batches of fewer rows, to hold fewer sets at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _often(sets: list[np.ndarray], ids: pd.Series) -> pd.DataFrame:
    every, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
    often = np.nonzero(counts >= FREQUENT_FROM)[0]
    often = often[np.argsort(-counts[often], kind="stable")[:FREQUENT]]
    return pd.DataFrame({"kind": 1, "doc_id": ids.iloc[:0].reindex(range(len(often))).array, "mark": _signed(every[often]), "n": counts[often], "f1": 0, "f2": 0})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of documents (kind 0: doc_id, the text's mark, n, fingerprint) and of shingles frequent here (kind 1: hash, count)."""
    held, n, ids = [], 0, None
    for batch in _slices(batches):
        found = [shingles(t) for t in batch["text"]]
        marks = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in found]
        yield pd.DataFrame({"kind": 0, "doc_id": batch["doc_id"].array, "mark": batch["mark"].array, "n": [len(s) for s in found], "f1": [m[0] for m in marks], "f2": [m[1] for m in marks]})
        held += found
        n, ids = n + sum(map(len, found)), batch["doc_id"]
        if n >= COUNTED:
            yield _often(held, ids)
            held, n = [], 0
    if held:
        yield _often(held, ids)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def group_counts(s: np.ndarray, groups: int) -> bytes:
    """How many of the hashes fall into each group, at most FULL, a byte each."""
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % groups, minlength=groups), FULL).astype(np.uint8).tobytes()


def _points(frequent: np.ndarray, place: np.ndarray):
    """Rows (doc_id, mark, n, vec, prefix): group counts as bytes, prefix in the common order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows, ids = [], []
            for k, (mark, text) in enumerate(zip(batch["mark"], batch["text"], strict=True)):
                s = shingles(text)
                if not len(s):
                    continue
                p = prefix_length(len(s))
                first = s[: p + 64]
                at = np.minimum(np.searchsorted(frequent, first), max(len(frequent) - 1, 0))
                if len(frequent) and (frequent[at] == first).any():
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    often = frequent[at] == s
                    first = np.concatenate([s[~often], s[often][np.argsort(place[at[often]], kind="stable")]])
                rows.append((mark, len(s), group_counts(s, GROUPS), _signed(first[:p].copy())))
                ids.append(k)
            out = pd.DataFrame(rows, columns=["mark", "n", "vec", "prefix"])
            out.insert(0, "doc_id", batch["doc_id"].iloc[ids].array)
            yield out

    return run


def overlap_bound(na, nb, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of coordinate minima; where a count may have been cut off at FULL on both sides, the smaller size."""
    least = np.minimum(v, w)
    return np.where((least == FULL).any(axis=1), np.minimum(na, nb), least.sum(axis=1, dtype=np.int64))


def may_link(na, nb, overlap, percent: int = PERCENT):
    """100 * overlap >= percent * union, for counts or arrays of counts."""
    return 100 * overlap >= percent * (na + nb - overlap)


class Tree:
    """A bulk-loaded R-tree. Points come with their element's number in ascending order; within an element they are packed by
    set size, in slabs, and by how their counts lean to one half of the groups. ``levels[0]`` are the points themselves, each
    higher level bounds runs of FAN entries of the one below: element, size and component from lowest to highest, and the
    highest count in each group."""

    def __init__(self, key: np.ndarray, n: np.ndarray, vec: np.ndarray, comp: np.ndarray):
        half = vec[:, : GROUPS // 2].sum(axis=1, dtype=np.int64)
        slab = np.floor(np.log(n) / np.log(1.05)).astype(np.int64)
        self.order = np.lexsort((half, slab, key))
        key, n, vec, comp = (x[self.order] for x in (key, n, vec, comp))
        self.levels = [(key, key, n, n, comp, comp, vec)]
        while len(self.levels[-1][0]) > 1:
            k1, k2, n1, n2, c1, c2, top = self.levels[-1]
            at = np.arange(0, len(k1), FAN)
            low, high = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append((low(k1, at), high(k2, at), low(n1, at), high(n2, at), low(c1, at), high(c2, at), high(top, at, axis=0)))

    def _meet(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the entry pairs (a, b) of a level those that may hold a link."""
        k1, k2, n1, n2, c1, c2, top = self.levels[level]
        good = (k1[a] <= k2[b]) & (k1[b] <= k2[a]) & (100 * n2[a] >= percent * n1[b]) & (100 * n2[b] >= percent * n1[a])
        good &= (c1[a] != c2[a]) | (c1[b] != c2[b]) | (c1[a] != c1[b])
        a, b = a[good], b[good]
        kept = [np.zeros(0, bool)]
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            # the smallest sizes need the least overlap
            kept.append(may_link(n1[x], n1[y], overlap_bound(n2[x], n2[y], top[x], top[y]), percent))
        kept = np.concatenate(kept)
        return a[kept], b[kept]

    def self_join(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (places in the caller's order) that pass all tests, some at a time."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(self.levels) > 1 else []
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(a), 2 * PAIRS // FAN**2):
                x, y = a[at : at + 2 * PAIRS // FAN**2], b[at : at + 2 * PAIRS // FAN**2]
                one = np.repeat(x[:, None] * FAN + np.arange(FAN), FAN, axis=1).ravel()
                two = np.tile(y[:, None] * FAN + np.arange(FAN), (1, FAN)).ravel()
                real = (one < below) & (two < below) & ((one < two) if level == 1 else (one <= two))
                one, two = self._meet(level - 1, one[real], two[real], percent)
                if len(one):
                    todo.append((level - 1, one, two))


def _tree_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (token, cell): the runs of equal (token, cell) in a batch, each of bounded size, make one tree. Odd
    cells hold two chunks (``side``): pairs within one of them are met in that chunk's own cell. Pairs whose prefixes agree one
    element earlier too (``prev``) are met at that element."""
    held: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        node, n, comp, side, prev, cell = (rows[c].to_numpy() for c in ("node", "n", "comp", "side", "prev", "cell"))
        vec = np.frombuffer(b"".join(rows["vec"]), np.uint8).reshape(len(rows), GROUPS)
        same = (rows["token"].to_numpy()[1:] == rows["token"].to_numpy()[:-1]) & (cell[1:] == cell[:-1])
        for i, j in Tree(np.concatenate([[0], np.cumsum(~same)]), n, vec, comp).self_join():
            good = ((cell[i] % 2 == 0) | (side[i] != side[j])) & ((prev[i] != prev[j]) | (prev[i] == 0))
            i, j = i[good], j[good]
            yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        other = ((rows["token"] != rows["token"].iloc[-1]) | (rows["cell"] != rows["cell"].iloc[-1])).to_numpy()
        whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if whole:
            yield from solve(rows.iloc[:whole])
        held = rows.iloc[whole:]
    if held is not None and len(held):
        yield from solve(held)


def _bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _slices(batches):
        if len(batch):
            v, w = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), -1) for c in ("vec", "vec2"))
            n, n2 = batch["n"].to_numpy(), batch["n2"].to_numpy()
            yield batch.loc[may_link(n, n2, overlap_bound(n, n2, v, w)), ["a", "b"]]


def _fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in _slices(batches):
        out = pd.DataFrame([(len(s), group_counts(s, FINE)) for s in map(shingles, batch["text"])], columns=["n", "vec"])
        out.insert(0, "node", batch["node"].array)
        yield out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one b together: its set is made once."""
    last, t = None, np.zeros(0, np.uint64)
    for batch in _slices(batches):
        good = []
        for b, x, y in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if b != last:
                last, t = b, shingles(y)
            s = shingles(x)
            good.append(bool(may_link(len(s), len(t), np.intersect1d(s, t, assume_unique=True).size)))
        yield batch.loc[good, ["a", "b"]]


def _rows_of(side: str, pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, text) of the nodes on one side of pairs, as often as a row stands for its node, and the settled table that they are
    picked by."""
    nodes = pairs.select(F.col(side).alias("node")).distinct()
    of = settle(classes.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("rep"), F.col("mark").alias("rep_mark")), "nodes")
    return picked(docs, of, (F.col("doc_id") == F.col("rep")) & (F.col("mark") == F.col("rep_mark"))).select("node", "text"), of


def _bounded_finely(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs, settled, that fine counts leave over: of long texts, the coarse ones leave many that don't link."""
    pairs = settle(pairs, "wide-pairs")
    (left, of_left), (right, of_right) = (_rows_of(side, pairs, docs, classes) for side in "ab")
    left, right = (rows.mapInPandas(_fine, "node long, n long, vec binary").dropDuplicates(["node"]) for rows in (left, right))
    one = pairs.join(left.select(F.col("node").alias("a"), "n", "vec"), "a")
    both = salted(one, right.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("vec").alias("vec2")), "b", "a", of=pairs)
    out = settle(both.mapInPandas(_bounded, "a long, b long"), "pairs")
    forget(pairs, of_left, of_right)
    return out


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts link. Only texts of nodes in pairs that finer counts leave over are shuffled, each
    for the sides that it stands on."""
    pairs = _bounded_finely(pairs, docs, classes)
    (left, of_left), (right, of_right) = (_rows_of(side, pairs, docs, classes) for side in "ab")
    # a row that stands for a node, wherever it lies; rows that repeat it are left out
    left, right = (rows.dropDuplicates(["node"]) for rows in (left, right))
    one = pairs.join(left.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = salted(one, right.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b", "a", of=pairs)
    links = settle(both.mapInPandas(_verify, "a long, b long"), "links")
    forget(pairs, of_left, of_right)
    return links


def shared_filter(shared: DataFrame) -> np.ndarray:
    """Bits of the hashes of ``shared`` (token), of one size whatever their number: at most 2 ** FILTER_BITS / 8 bytes."""
    cell = F.col("token").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parts = shared.groupBy(F.shiftright(cell, 15).cast("int").alias("at")).agg(F.bitmap_construct_agg(cell.bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    out = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    for at, bits in zip(parts["at"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[at] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _rows(bits):
    """A row (node, n, token, prev) for each prefix element that the filter doesn't rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = (1 << FILTER_BITS) - 1
        for batch in _slices(batches):
            size = np.fromiter(map(len, batch["prefix"]), np.int64, len(batch))
            token = np.concatenate([*batch["prefix"], np.zeros(0, np.int64)]).astype(np.int64)
            prev = np.concatenate([np.zeros(1, np.int64), token[:-1]])[: len(token)]
            prev[(np.cumsum(size) - size)[size > 0]] = 0
            cell = token & mask
            keep = bits.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0
            yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), size)[keep], "n": np.repeat(batch["n"].to_numpy(), size)[keep], "token": token[keep], "prev": prev[keep]})

    return run


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with marks -> all rows (doc_id, mark, n, f1, f2), frequent shingles, and a node for each distinct set that isn't
    empty: node, size, and doc_id and mark of its least row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = settle(docs.mapInPandas(_sets, f"kind int, doc_id {kind}, mark long, n long, f1 long, f2 long"), "sets")
    rows = first.filter("kind = 0").drop("kind")
    own = rows.filter("doc_id is not null and n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.count(F.lit(1)).alias("size"))
    # nodes in order of doc_id: the least document of near copies, most often what they were copied from, leads them
    own = own.select("f1", "f2", "size", "least.doc_id", "least.mark").orderBy("doc_id", "mark")
    classes = settle(own.withColumn("node", F.monotonically_increasing_id()), "classes")
    rows.settled_path = first.settled_path
    return rows, first.filter("kind = 1").select("mark", "n"), classes


def node_links(docs: DataFrame, frequent: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all nodes that links join."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    often = frequent.groupBy("mark").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "mark").limit(FREQUENT).toArrow().to_pandas()
    known = often["mark"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    place = -np.arange(len(known))[order]  # the most frequent one is last of all
    made = docs.filter("doc_id is not null").mapInPandas(_points(known[order], place), f"doc_id {kind}, mark long, n long, vec binary, prefix array<long>")
    reps = classes.select("node", F.col("doc_id").alias("rep"), F.col("mark").alias("rep_mark"))
    points = made.join(reps, (F.col("doc_id") == F.col("rep")) & (F.col("mark") == F.col("rep_mark"))).dropDuplicates(["doc_id", "mark"])
    points = settle(points.select("node", "n", "vec", "prefix"), "points")

    tokens = points.select("node", F.explode("prefix").alias("token"))
    shared = settle(tokens.groupBy("token").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    bits = spark.sparkContext.broadcast(shared_filter(shared))
    sent = points.select("node", "n", "prefix").mapInPandas(_rows(bits), "node long, n long, token long, prev long")
    # elements of several nodes only: what comes after works on these
    sent = settle(sent, "sent")
    # of an element's points in order of size, only those stay that have a neighbour near enough in size; the least node of each
    # run of such neighbours leads it. Elements that are dealt to several tasks keep all points and one leader
    met = salted(sent, shared, "token", "node", keep=True, counts=shared.select("token", F.col("size").alias("rows_")))
    by_size = Window.partitionBy("token", "salt_").orderBy("n")
    met = met.withColumn("run", F.sum(F.when(PERCENT * F.col("n") <= 100 * F.lag("n").over(by_size), 0).otherwise(1)).over(by_size))
    run, hot = Window.partitionBy("token", "salt_", "run"), F.col("copies_") > 1
    met = met.withColumns({"in_run": F.count(F.lit(1)).over(run), "leads": F.min("node").over(run)}).filter(hot | (F.col("in_run") > 1))
    rows = settle(met.select("token", "node", "n", "prev", "size", F.when(hot, F.col("leader")).otherwise(F.col("leads")).alias("leader")), "buckets")
    forget(sent)
    flat = points.select("node", "n", "vec")

    # one leader for each node
    led = rows.filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    best = led.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("leader"))
    near = settle(best.select(F.col("node").alias("a"), F.col("leader").alias("b")), "leaders")
    side = lambda at, n, vec: flat.select(F.col("node").alias(at), F.col("n").alias(n), F.col("vec").alias(vec))
    # the leader is b: rows of one leader are verified together
    links = verified(salted(near.join(side("a", "n", "vec"), "a"), side("b", "n2", "vec2"), "b", "a", of=near).mapInPandas(_bounded, "a long, b long"), docs, classes)
    parts = components(links)

    # across those components, all pairs that the tree can't rule out
    told = rows.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").select("token", "node", "n", "prev", "size", F.coalesce("component", "node").alias("comp"))
    told = settle(told, "told")
    mixed = told.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("rows_"))
    mixed = settle(mixed.filter("c1 <> c2").select("token", "rows_"), "mixed")
    cells = F.ceil(F.col("size") / F.lit(CELL)).cast("int")
    dealt = salted(told, mixed.select("token"), "token", "node", counts=mixed).withColumn("own", F.pmod(F.xxhash64("node"), cells).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # odd cells hold two chunks
    cell = 2 * (low.cast("long") * (1 << 30) + high) + (low != high).cast("long")
    dealt = dealt.select("token", cell.alias("cell"), "node", "n", "comp", "prev", F.col("own").alias("side")).join(flat.select("node", "vec"), "node")
    dealt = dealt.repartition("token", "cell").sortWithinPartitions("token", "cell")
    more = verified(dealt.mapInPandas(_tree_pairs, "a long, b long").distinct(), docs, classes)
    out = settle(links.union(more), "all-links")
    forget(points, shared, rows, near, told, mixed, links, more, parts)
    return out


def link(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    docs = texts(docs).withColumn("mark", F.xxhash64("text"))
    rows, frequent, classes = classes_of(docs)
    links = node_links(docs, frequent, classes)
    # a doc_id with several sets joins their nodes
    several = rows.filter("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("one"), F.max(F.struct("f1", "f2")).alias("two")).filter("one <> two").select("doc_id")
    again = rows.filter("n > 0").join(several, "doc_id").select("doc_id", "f1", "f2").distinct().join(classes.select("f1", "f2", "node"), ["f1", "f2"])
    again = settle(again.select("doc_id", "node"), "repeated-ids")
    least = again.groupBy(F.col("doc_id").alias("of")).agg(F.min("node").alias("a"))
    joined = settle(links.union(again.join(least, F.col("doc_id") == F.col("of")).select("a", F.col("node").alias("b")).filter("a <> b")), "all-links")
    parts = components(joined)
    # the least doc_id of each component that has several nodes, and of all others their own
    placed = settle(classes.join(parts, F.col("node") == F.col("id"), "left").select("f1", "f2", "size", "doc_id", "component"), "placed")
    least = placed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = salted(placed.filter("component is not null").select("f1", "f2", "component"), least, "component", "f1").select("f1", "f2", "component_id")
    ids = settle(linked.union(placed.filter("component is null").select("f1", "f2", F.col("doc_id").alias("component_id"))), "ids")
    forget(links, again, joined, parts, placed, classes)
    single = F.col("doc_id").isNull() | (F.col("n") == 0)
    known = salted(rows.filter(~single), ids, ("f1", "f2"), "mark", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.union(rows.filter(single).select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of its least doc_id; documents without words or doc_id stay as they are. Of
    rows with that least doc_id, each different text stays once."""
    names = docs.columns
    linked = settle(link(docs), "linked")
    gone = linked.filter("component_id <> doc_id").select("doc_id").distinct()
    again = linked.filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    whole = docs.select(F.col("doc_id").alias("own_id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row_"))
    kept = picked(whole, settle(gone, "gone"), F.col("own_id") == F.col("doc_id"), "left_anti")
    again = settle(again, "again")
    if again.isEmpty():
        return kept.select("row_.*")
    once = picked(kept, again, F.col("own_id") == F.col("doc_id"), "left_anti")
    several = picked(kept, again, F.col("own_id") == F.col("doc_id"), "left_semi").withColumn("text_", F.col("row_.text")).dropDuplicates(["own_id", "text_"])
    return once.select("row_.*").unionByName(several.select("row_.*"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), s as (
  select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ') else array_to_string(words[i:i + 3], ' ') end as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from w where len(words) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)
), both_ways as (
  select a, b from links union select b, a from links
), reach(id, r) as (
  select distinct a, a from both_ways
  union
  select e.b, r.r from reach r join both_ways e on e.a = r.id
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.c, w.doc_id) as component_id
from w left join n using (doc_id) left join (select id, min(r) as c from reach group by id) m on m.id = w.doc_id
"""
