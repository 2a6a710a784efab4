"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target word total; every document of a source has the same expected number of takes
r = target / source size (0 to 3). A document is taken floor(r) times for certain, and once more with probability
frac(r). Those last takes are chosen by the cube method: a vector of inclusion probabilities walks through the null
space of the balancing constraints (document total and word total) until each coordinate is 0 or 1, apart from a few of the
smallest documents. Each step moves the largest open document, and the next ones in size make up for it, so what is left
open at the end is small and landing moves few words. The walk runs in blocks of a source, so that no task holds a whole
source; the open documents of each block meet in the next level's blocks, and the last level lands them.

Defined cases: null text counts no words; a null source is a source of its own and comes last; a source without words
has target 0; rows with equal ids and sizes are separate documents; an empty table gives an empty result; other columns
are ignored. A source whose words lie in few documents can't come nearer than those allow. Ties and draws come from hashes of ids, so reruns agree however the rows are dealt.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle
from .skew import fits

WEIGHTS = (5, 2, 1)
MOST_TAKES = 3
#: Documents that one walk holds on average.
BLOCK = 2048
#: Rows of one id that stay together.
HOT_ROWS = 256
#: Open documents that make up for the largest one's move.
WINDOW = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TAKES) -> DataFrame:
    """One row per source: n, source_size, target. Targets share the total by weight; a target stops at ``most`` times
    the source's size and the excess is shared again: with sources in order of cap/weight, the capped ones are a prefix,
    and the level of the rest is the first that doesn't pass the next source's own."""
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    )
    cap = F.col("source_size") * F.lit(float(most))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(cap / F.col("weight"), "place")
    before = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before) / left
    fits = F.when(level <= cap / F.col("weight"), F.struct(cap / F.col("weight"), F.col("place"), level.alias("level")))
    per = per.withColumn("own", fits).withColumn("level", F.min("own").over(every)["level"])
    return per.select("source", "n", "source_size", F.least(cap, F.col("level") * F.col("weight")).alias("target"))


def _direction(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A move of open documents that keeps their number and their words, the first one's by 1, the others' by what is left to
    them; where the others can't make up for both, by their words alone; where not even that, a move without the first."""
    room = p * (1 - p)
    room[0] = 0.0
    s0, s1, s2 = room.sum(), room @ size, room @ (size * size)
    det = s0 * s2 - s1 * s1
    if det > 1e-9 * s0 * s2:
        a, b = (s2 - s1 * size[0]) / det, (s0 * size[0] - s1) / det
        out = -room * (a + b * size)
    elif s1 <= 0 < size[0]:  # only documents without words beside it
        out = np.zeros(len(p))
        out[1], out[2] = 1.0, -1.0
        return out
    else:
        out = -room * (size[0] / s1 if size[0] else 1 / s0)
    out[0] = 1.0
    return out


def walk(pi: np.ndarray, size: np.ndarray, rng: random.Random, land: bool) -> np.ndarray:
    """Flight of the cube method on constraints (1, size) over documents in descending order of size, up to WINDOW open
    ones at a time. ``land``: also settle the last two, on the word total first, then by a plain draw."""
    low, high = 1e-9, 1 - 1e-9
    pi, size = np.asarray(pi, float), np.asarray(size, float)
    pi = np.where(pi <= low, 0.0, np.where(pi >= high, 1.0, pi))
    fresh = np.flatnonzero((pi > 0) & (pi < 1))
    at = min(WINDOW, len(fresh))
    open_ = fresh[:at]
    p, s = pi[open_], size[open_]

    def step(u: np.ndarray) -> None:
        nonlocal p, s, open_
        moved = np.flatnonzero(np.abs(u) > 1e-300)
        v, q = u[moved], p[moved]
        up = float(np.min(np.where(v > 0, 1 - q, q) / np.abs(v)))
        down = float(np.min(np.where(v > 0, q, 1 - q) / np.abs(v)))
        p = p + u * (up if rng.random() * (up + down) < down else -down)
        ended = (p <= low) | (p >= high)
        if ended.any():
            pi[open_[ended]] = (p[ended] > 0.5).astype(float)
            p, s, open_ = p[~ended], s[~ended], open_[~ended]

    while True:
        if len(p) < WINDOW // 2 and at < len(fresh):
            more = fresh[at : at + WINDOW - len(p)]
            at += len(more)
            open_, p, s = np.concatenate([open_, more]), np.concatenate([p, pi[more]]), np.concatenate([s, size[more]])
        if len(p) < 3:
            break
        step(_direction(p, s))
    if land and len(p) == 2:
        step(np.array([s[1], -s[0]]) if s[0] and s[1] else np.array([1.0, -1.0]))
    while land and len(p):
        step(np.eye(1, len(p))[0])
    pi[open_] = p
    return pi


def _fly(seed: int, land_below: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        rng = random.Random(f"{seed}|{pdf['source'].iat[0]}|{pdf['block'].iat[0]}|{len(pdf)}")
        pdf["pi"] = walk(pdf["pi"].to_numpy(float), pdf["size"].to_numpy(float), rng, bool(pdf["blocks"].iat[0] <= land_below))
        return pdf.drop(columns=["block", "blocks"])

    return run


def spread_keys(sizes: DataFrame, seed: int) -> DataFrame:
    """``sizes``, settled, with the hash h that deals a row to its block: its id's, and where an id has so many rows that they
    would fill blocks, also of a number that deals them apart."""
    many = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows_")).filter(F.col("rows_") > HOT_ROWS).select(F.col("doc_id").alias("many_"), F.ceil(F.col("rows_") / HOT_ROWS).alias("shares_"))
    many = settle(many, "mix-hot")
    numbered = sizes.withColumn("nth_", F.monotonically_increasing_id()).join(F.broadcast(many) if fits(many) else many, F.col("doc_id").eqNullSafe(F.col("many_")), "left")
    h = F.when(F.col("shares_").isNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("doc_id", F.lit(seed), F.pmod(F.xxhash64("nth_"), F.col("shares_"))))
    return numbered.withColumn("h", h).drop("nth_", "many_", "shares_")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TAKES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken; one row per document."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size")), "mix-sizes")
    per = settle(source_targets(sizes, weights, most), "mix-sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = lambda left: left.join(per.select(F.col("source").alias("s"), "n", rate.alias("rate")), F.col("source").eqNullSafe(F.col("s")), "left")
    whole = F.floor(F.col("rate") + 1e-9)
    keyed = spread_keys(sizes, seed)
    state = same(keyed).select(
        "doc_id", "source", "size", "h", "n", whole.cast("int").alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("pi")
    )
    most_rows = per.agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    level, bound = 0, most_rows
    fields = "doc_id {}, source string, size long, h long, n long, whole int, pi double".format(sizes.schema["doc_id"].dataType.simpleString())
    while True:
        blocks = F.ceil(F.col("n") / F.lit(block))
        dealt = state.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks")))
        moved = settle(dealt.groupBy("source", "block").applyInPandas(_fly(seed + level, 1), fields), f"mix-level{level}")
        last = bound <= block
        done.append(moved if last else moved.filter("pi <= 0 or pi >= 1"))
        if last:
            break
        # each block leaves two open documents at most; those of a source meet next
        state = moved.filter("pi > 0 and pi < 1").withColumn("n", 2 * F.ceil(F.col("n") / F.lit(block)))
        bound, level = 2 * -(-bound // block), level + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    out = rows.join(per.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")), "left")
    copies = (F.col("whole") + F.round("pi").cast("int")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` repeated as often as ``mix`` takes it. The takes go to the rows where they are
    few bytes, by their size; else whole rows are shuffled once, to meet them."""
    mixed = mix(docs, **options).groupBy("doc_id", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    mixed = settle(mixed, "mix-takes").withColumnsRenamed({"doc_id": "of_id", "size": "of_size"})
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.col("doc_id").alias("id_"), words.alias("size_"))
    same = F.col("id_").eqNullSafe(F.col("of_id")) & (F.col("size_") == F.col("of_size"))

    def repeated(rows: DataFrame, own: Column) -> DataFrame:
        rows = rows.withColumn("own_", own.cast("int")).filter("own_ > 0")
        return rows.select("row_", F.explode(F.sequence(F.lit(1), F.col("own_"))).alias("nth_")).select("row_.*")

    sent = F.broadcast if fits(mixed) else lambda t: t
    several = mixed.filter("rows > 1")
    if several.isEmpty():
        return repeated(left.join(sent(mixed), same), F.col("copies"))
    # equal rows of one id share their takes: the first ones get one more. Which is first is drawn anew for each part of them,
    # so that no task holds all rows of an id
    part = F.pmod(F.xxhash64("row_"), F.ceil(F.col("rows") / F.lit(BLOCK))).cast("int")
    apart = left.join(sent(several), same).withColumn("part_", part)
    share = apart.groupBy("of_id", "of_size", "part_").agg(F.count(F.lit(1)).alias("n_"), F.max("rows").alias("rows_"), F.max("copies").alias("copies_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("of_id", "of_size").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = share.withColumn("before_", before).select(F.col("of_id").alias("share_id"), F.col("of_size").alias("share_size"), F.col("part_").alias("share_part"), "before_")
    met = apart.join(share, F.col("of_id").eqNullSafe(F.col("share_id")) & (F.col("of_size") == F.col("share_size")) & (F.col("part_") == F.col("share_part")))
    nth = F.col("before_") + F.row_number().over(Window.partitionBy("of_id", "of_size", "part_").orderBy(F.xxhash64("row_")))
    shared = repeated(met, F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0))
    return repeated(left.join(sent(mixed.filter("rows = 1")), same), F.col("copies")).unionByName(shared)
