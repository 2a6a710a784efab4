"""Nearest vectors through an index of cells: tables of vectors dealt by their nearest centre, of which a query visits the nearest few.

The centres are fitted on a bounded sample; every vector is indexed. How many cells a query visits is measured, not guessed: a few
hundred queries by least hash are answered over all cells, and as many cells are taken as hold the wanted share of those
answers. On vectors without any structure that is most cells, on grouped ones a few. Copies of a vector are one point
with its first ids, and one query, so they multiply nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..session import scratch

#: Vectors that centres are fitted on and most of them; vectors for each centre; queries that the number of cells is measured by.
SAMPLE, MOST_CELLS, PER_CELL, PROBE = 20_000, 2048, 500, 200
#: Vectors of a part of a cell, and queries of a block, at most; fewer where vectors are so long that they would take over PACKED bytes.
PART, TOGETHER, PACKED = 4096, 2048, 4 << 20
#: Blocks that few queries are dealt to, of FEWEST or more; tasks over the blocks; bytes of stored vectors that a task holds.
SPREAD, FEWEST, TASKS, SHARE = 64, 256, 128, 32 << 20
#: Numbers of a product, and rows of queries with their cells, that a task holds at once; answers before the worse ones go.
BLOCK, ROWS, PENDING = 1 << 20, 1 << 14, 1 << 18


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def _forget(table: DataFrame) -> None:
    """Delete a kept table that no later plan reads."""
    jvm = table.sparkSession._jvm
    where = jvm.org.apache.hadoop.fs.Path(table.kept_path)
    where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def _unit(df: DataFrame) -> DataFrame:
    """vec_id and the vector in length 1; null vectors and those with null or non-finite components take no part."""
    x = F.col("embedding")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return df.filter(whole).withColumn("norm_", F.greatest(scalar.norm(x), F.lit(1e-12))).select("vec_id", F.transform(x, lambda c: c / F.col("norm_")).alias("e"))


def _centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Means by direction, from evenly spread starts; a mean without members stays."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _by_cells(df: DataFrame, centres: np.ndarray, most: int) -> DataFrame:
    """``df`` (i, e) with the ``most`` nearest cells of each row: (cell, place) from 0."""

    def deal(batches):
        for b in batches:
            if not len(b):
                continue
            # a row for each cell: few rows at a time, or a batch would be held as often as it has cells
            for at in range(0, len(b), step := max(1, ROWS // most)):
                i, e = b["i"].to_numpy()[at : at + step], b["e"].to_numpy()[at : at + step]
                cells = np.argsort(-(np.stack(e) @ centres.T), axis=1, kind="stable")[:, :most]
                rows = np.repeat(np.arange(len(e)), cells.shape[1])
                yield pd.DataFrame({"i": i[rows], "e": e[rows], "cell": cells.ravel().astype(np.int32), "place": np.tile(np.arange(cells.shape[1], dtype=np.int32), len(e))})

    return df.select("i", "e").mapInPandas(deal, "i long, e array<double>, cell int, place int")


def _points(df: DataFrame, most: int, label: str) -> tuple[DataFrame, DataFrame]:
    """Unit rows (vec_id, e) -> distinct vectors (i, e, ids: the first ``most``), and (i, vec_id) of all rows."""
    w = Window.partitionBy("e").orderBy("vec_id")
    first = df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    points = _kept(first.groupBy("e").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("i", F.monotonically_increasing_id()), label)
    return points, df.join(points.select("e", "i"), "e").select("i", "vec_id")


def _rows(most: int, width: int) -> int:
    return max(1, min(most, PACKED // (8 * width)))


def _packed(*names: str):
    """One row of a group of (i, e): the named columns, which are equal in it, its numbers and its vectors."""

    def run(of: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [of[c].iloc[0]] for c in names}, "ids": [of["i"].to_numpy().tobytes()], "vectors": [np.stack(of["e"].to_numpy()).tobytes()]})

    return run


class _Asked:
    """A block of queries and the best ``k`` of what it has met so far, with all that tie with the last."""

    def __init__(self, q: np.ndarray, e: np.ndarray, centres: np.ndarray, probes: int, k: int):
        self.q, self.e, self.k = q, e, k
        #: Of each query and cell, the cell's place among the query's; -1 where it isn't visited.
        self.place = np.full((len(q), len(centres)), -1, np.int16)
        for at in range(0, len(q), step := max(1, BLOCK // len(centres))):
            near = np.argsort(-(e[at : at + step] @ centres.T), axis=1, kind="stable")[:, :probes]
            np.put_along_axis(self.place[at : at + step], near, np.arange(near.shape[1], dtype=np.int16)[None], 1)
        self.least, self.found, self.pending, self.most = np.full(len(q), -np.inf), [], 0, PENDING

    def meet(self, cell: int, i: np.ndarray, points: np.ndarray) -> None:
        rows = np.nonzero(self.place[:, cell] >= 0)[0]
        # some rows of the product at a time: whole it would be TOGETHER times PART numbers, several times over
        for at in range(0, len(rows), step := max(1, BLOCK // len(i))):
            some = rows[at : at + step]
            score = self.e[some] @ points.T
            fresh = np.nonzero(np.isneginf(self.least[some]))[0]
            if len(fresh) and len(i) >= self.k:
                self.least[some[fresh]] = np.round(np.partition(score[fresh], -self.k, axis=1)[:, -self.k], 6)
            a, b = np.nonzero(score >= self.least[some, None] - 1e-6)  # only these are rounded
            value, a = np.round(score[a, b], 6), some[a]
            stay = value >= self.least[a]
            self.found.append((a[stay], i[b[stay]], value[stay], self.place[a[stay], cell]))
            self.pending += int(stay.sum())
            if self.pending > self.most:
                self.found = [self.best()]
                self.pending = len(self.found[0][0])
                self.most = max(PENDING, 2 * self.pending)

    def best(self) -> tuple[np.ndarray, ...]:
        row, i, value, place = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((-value, row))
        row, i, value, place = row[order], i[order], value[order], place[order]
        first = np.searchsorted(row, np.arange(len(self.q) + 1))
        full = np.nonzero(np.diff(first) >= self.k)[0]
        self.least[full] = value[first[full] + self.k - 1]
        stay = value >= self.least[row]
        return row[stay], i[stay], value[stay], place[stay]

    def told(self) -> pa.RecordBatch:
        row, i, value, place = self.best()
        return pa.RecordBatch.from_arrays([pa.array(self.q[row]), pa.array(i), pa.array(value), pa.array(place.astype(np.int32))], ["q", "i", "score", "place"])


@dataclass
class VectorIndex:
    """``cells`` (cell, ids, vectors: of a part of the cell, packed), dealt to ``shares`` tasks; ``points`` (i, ids)."""

    cells: DataFrame
    shares: int
    points: DataFrame
    centres: np.ndarray
    probes: int
    #: Share of the measured queries' nearest that lie in that many cells.
    recall: float
    most: int

    def _scored(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """queries (i, e) -> q, i, score, place (the cell's, among the query's): the k best points of each query in each share of the
        cells, with ties. Blocks of queries and parts of cells meet as whole rows in a product without a shuffle, so that a query is
        neither written nor sent once for each cell it visits; a block is of queries near to each other, and meets the cells that any visits."""
        centres, width = self.centres, self.centres.shape[1]
        dealt = _kept(_by_cells(queries, centres, 1).drop("place"), "vector-asked")
        sizes = sorted(map(tuple, dealt.groupBy("cell").count().collect()))  # MOST_CELLS rows at most
        most = _rows(min(TOGETHER, max(FEWEST, sum(n for _, n in sizes) // SPREAD)), width)
        spans, total = [], 0
        for cell, n in sizes:
            spans.append((cell, total // most, (total + n - 1) // most - total // most + 1))
            total += n
        spans = queries.sparkSession.createDataFrame(spans, "cell int, first int, copies int")
        blocks = dealt.join(F.broadcast(spans), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("i"), F.col("copies")).cast("int"))

        def visiting(of: pd.DataFrame) -> pd.DataFrame:
            e, step = of["e"].to_numpy(), max(1, BLOCK // len(centres))
            near = [np.unique(np.argsort(-(np.stack(e[at : at + step]) @ centres.T), axis=1, kind="stable")[:, :probes]) for at in range(0, len(e), step)]
            return _packed("block")(of).assign(visits=[np.unique(np.concatenate(near)).astype(np.int32)])

        asked = _kept(blocks.groupBy("block").applyInPandas(visiting, "block int, ids binary, vectors binary, visits array<int>"), "vector-blocks")
        _forget(dealt)
        asked = asked.select("block", F.col("ids").alias("q"), F.col("vectors").alias("e"), "visits").repartition(max(1, min(TASKS, -(-total // most))))
        stored = self.cells.repartition(self.shares).hint("shuffle_replicate_nl")
        met = asked.join(stored, F.array_contains("visits", F.col("cell"))).drop("visits")

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                blocks, q, e, cells, ids, vectors = (batch.column(c) for c in ("block", "q", "e", "cell", "ids", "vectors"))
                for r, (block, cell) in enumerate(zip(blocks.to_pylist(), cells.to_pylist(), strict=True)):
                    if block != at:  # a block's rows come one after another
                        if held:
                            yield held.told()
                        at, held = block, _Asked(np.frombuffer(q[r].as_buffer(), np.int64).copy(), np.frombuffer(e[r].as_buffer()).reshape(-1, width).copy(), centres, probes, k)
                    held.meet(cell, np.frombuffer(ids[r].as_buffer(), np.int64), np.frombuffer(vectors[r].as_buffer()).reshape(-1, width))
            if held:
                yield held.told()

        return met.mapInArrow(best, "q long, i long, score double, place int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """queries (vec_id, embedding) -> query_id, vec_id, score, rank: the k nearest other ids by cosine, ties by id, as far as
        they lie in the visited cells. At most ``most`` - 1 neighbours can be asked for."""
        if k >= self.most:
            raise ValueError(f"this index keeps {self.most} ids of a vector: ask for fewer than that")
        asked, rows = _points(_unit(queries), 1, "vector-queries")
        found = self._scored(asked.select("i", "e"), k + 1, probes or self.probes)
        found = found.withColumn("n", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("n") <= k + 1)
        w = Window.partitionBy("q").orderBy(F.desc("score"), "first")
        found = found.join(self.points.select("i", "ids", F.element_at("ids", 1).alias("first")), "i").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
        every = rows.select(F.col("i").alias("q"), F.col("vec_id").alias("query_id")).join(found, "q").select("query_id", "score", F.explode("ids").alias("vec_id")).filter("query_id <> vec_id")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return every.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def build_index(vectors: DataFrame, recall: float = 0.9, k: int = 10, cells: int | None = None, probes: int | None = None, most: int = 64) -> VectorIndex:
    """vectors (vec_id, embedding), all of one length. ``probes``: cells a query visits; if left out, as few as hold ``recall`` of the
    measured queries' k nearest. ``most``: ids kept of equal vectors."""
    points, _ = _points(_unit(vectors), most, "vector-points")
    n = points.count()
    sample = points.orderBy(F.xxhash64("e")).limit(SAMPLE).select("e").toPandas()["e"]
    matrix = np.stack(sample.to_numpy()) if len(sample) else np.zeros((1, 1))
    centres = _centres(matrix, cells or int(np.clip(n // PER_CELL, 1, min(MOST_CELLS, len(matrix)))))
    dealt = _kept(_by_cells(points, centres, 1).drop("place"), "vector-cells")
    width = centres.shape[1]
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / _rows(PART, width)).cast("int").alias("parts"))
    parted = dealt.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("i"), F.col("parts")).cast("int"))
    stored = _kept(parted.groupBy("cell", "part").applyInPandas(_packed("cell"), "cell int, ids binary, vectors binary"), "vector-parts")
    _forget(dealt)
    index = VectorIndex(stored, max(1, -(-n * width * 8 // SHARE)), points.select("i", "ids"), centres, probes or len(centres), 1.0, most)
    if probes is None and n:
        some = points.orderBy(F.xxhash64("e", F.lit(1))).limit(PROBE).select("i", "e")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "i")
        near = index._scored(some, k + 1, len(centres)).filter("q <> i").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k)
        place = np.sort(near.select("place").toPandas()["place"].to_numpy())  # PROBE times k rows at most
        if len(place):
            index.probes = int(place[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
            index.recall = float((place < index.probes).mean())
    return index


def recall_of(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """found, wanted, recall of the index's answers against those over all cells."""
    exact, got = index.search(queries, k, len(index.centres)), index.search(queries, k)
    both = exact.join(got.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted")).withColumn("recall", F.col("found") / F.col("wanted"))


__all__: Sequence[str] = ("VectorIndex", "build_index", "recall_of")
