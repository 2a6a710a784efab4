"""Language-model scoring: prediction by partial matching over bytes, beside a smoothed word unigram.

Byte grams of the training documents are counted in Spark; shorter contexts' counts are sums of longer ones'. They are a
static trie, each depth of it a table of all its grams and one of all its contexts: escape by method C (distinct symbols
against occurrences) and full exclusion of the symbols that a longer context has. As the symbols of a context contain those
of each longer one, what exclusion leaves of the next shorter context is one pair of numbers for each context.

What a gram of the longest order scores depends on it alone. The most frequent ones (a bounded number) are broadcast with
their scores; every other gram of every text, seen in training or not, meets the trie's tables in joins, order by order.
How many are broadcast changes no result.

The unigram's counts stay a distributed table: the most frequent tokens (a bounded number) are broadcast, every other
token of every text meets its count in a join.

Defined cases: null and empty texts hold the end token alone; null doc_ids count as training rows; repeated rows are counted
and scored one by one; without training rows all bytes are equally likely; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, settle, texts

ORDER = 4
START, STOP = b"\xfe" * ORDER, b"\xff"  # neither byte occurs in UTF-8
#: Grams in the broadcast part of the trie.
MOST_GRAMS = 1_000_000
#: Tokens in the broadcast part of the word counts.
MOST_WORDS = 150_000
ALPHA = 0.1
CHUNK = 1 << 20


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8") for w in text.encode("utf-8").lower().split()]


def grams_of(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The last order + 1 bytes at each position from ``order`` on, as one number."""
    key = np.zeros(max(len(data) - order, 0), np.int64)
    for k in range(order + 1):
        key = (key << 8) | data[k : len(data) - order + k]
    return key


def _chunks(all_texts, most: int = CHUNK):
    """Lists of encoded texts of about ``most`` bytes together."""
    held, n = [], 0
    for t in all_texts:
        held.append(t.encode("utf-8"))
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _laid_out(many: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all texts with start and stop, whether they end on a text's own byte, and each text's first gram."""
    data = np.frombuffer(b"".join(START + t + STOP for t in many), np.uint8)
    sizes = np.array([len(t) + 1 for t in many])
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    inside = np.ones(len(data) - ORDER, bool)
    # grams that end on a later text's start bytes say nothing
    for k in range(ORDER):
        at = starts[1:] + k - ORDER
        inside[at] = False
    return grams_of(data), inside, starts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    keys, counts = [], []

    def told(tally: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(tally), "gram": None, "n": list(tally.values())}).astype({"gram": "Int64"})

    for batch in batches:
        for many in _chunks(batch["text"]):
            gram, inside, _ = _laid_out(many)
            k, c = np.unique(gram[inside], return_counts=True)
            keys.append(k)
            counts.append(c)
            for t in many:
                words.update(w.decode("utf-8") for w in t.lower().split())
            words[""] += len(many)
            if len(words) > 400_000:
                yield told(words)
                words = Counter()
        if keys:
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts = [k], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]
            if len(k) > 1_500_000:
                yield pd.DataFrame({"word": None, "gram": keys[0], "n": counts[0]})
                keys, counts = [], []
    # a task may have no rows, and an empty column of words has no type that Arrow takes
    if words:
        yield told(words)
    if keys:
        yield pd.DataFrame({"word": None, "gram": keys[0], "n": counts[0]})


class Table:
    """Positions of known 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slots, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slots[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.nonzero(free)[0][first]
            self.slots[at[put]], self.values[at[put]] = keys[todo[put]], todo[put]
            left = np.ones(len(todo), bool)
            left[put] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        slots = self.slots[at]
        out = np.where(slots == keys, self.values[at], -1)
        todo = np.nonzero((slots != keys) & (slots != -1))[0]
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            slots = self.slots[at]
            hit = slots == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (slots != -1)
            todo, at = todo[go], at[go]
        return out


class Shared:
    """What is broadcast. Each Python worker indexes the grams when it first scores."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray, words: dict[str, float]):
        self.grams, self.logs, self.words = grams, logs, words

    @cached_property
    def places(self) -> Table:
        return Table(self.grams)

    def score(self, many: list[bytes], order: int) -> Iterator[tuple[float, np.ndarray | None, np.ndarray | None]]:
        """For each text, the log10 probability of its grams that are known here, the other grams and how often they occur."""
        gram, inside, starts = _laid_out(many)
        gram &= (1 << 8 * (order + 1)) - 1
        hit = self.places.find(gram)
        known = np.zeros(len(gram))
        at = np.nonzero(inside & (hit >= 0))[0]
        known[at] = self.logs[hit[at]]
        rest = np.nonzero(inside & (hit < 0))[0]
        cuts = np.searchsorted(rest, starts)
        for total, a, b in zip(np.add.reduceat(known, starts), cuts, [*cuts[1:], len(rest)], strict=True):
            yield (total, *(np.unique(gram[rest[a:b]], return_counts=True) if a < b else (None, None)))


def trie(grams: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """grams (gram, n) of the longest order -> for each context length from 0 up, all its grams (key, n) and all its contexts
    (context, total, distinct, and what is left of the next shorter context when they rule their own symbols out)."""
    levels = []
    for k in range(order, -1, -1):
        grams = settle(grams.groupBy((F.col("gram") % 256 ** (k + 1)).alias("gram")).agg(F.sum("n").alias("n")), f"grams-{k}")
        levels.append(grams.withColumnRenamed("gram", "key"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, own in enumerate(levels[::-1]):
        # up to 65,536 rows, whatever the input
        few = F.broadcast if k <= 2 else lambda df: df
        if k:
            lower = few(out[-1][0].select(F.col("key").alias("below"), F.col("n").alias("n_below")))
            own_below = own.withColumn("below", F.col("key") % 256**k).join(lower, "below", "left")
        else:
            own_below = own.withColumn("n_below", F.lit(0).cast("long"))
        contexts = own_below.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum("n_below").alias("seen"))
        if k:
            few = F.broadcast if k <= 3 else lambda df: df
            shorter = few(out[-1][1].select(F.col("context").alias("shorter"), F.col("total").alias("all"), F.col("distinct").alias("kinds")))
            contexts = contexts.withColumn("shorter", F.col("context") % 256 ** (k - 1)).join(shorter, "shorter", "left")
        else:
            contexts = contexts.withColumns({"all": F.col("seen"), "kinds": F.col("distinct")})
        contexts = contexts.select("context", "total", "distinct", (F.col("all") - F.col("seen")).alias("left_total"), (F.col("kinds") - F.col("distinct")).alias("left_distinct"))
        out.append((own, settle(contexts, f"contexts-{k}")))
    return out


def log10(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Distinct grams of the longest order -> gram, log: log10 probability of its last byte after its others."""
    none = F.lit(None).cast("long")
    # total and distinct: what exclusion leaves, where a longer context was known
    todo, done = grams.select("gram", F.lit(0.0).alias("log"), none.alias("total"), none.alias("distinct")), []
    for k in range(len(levels) - 1, -1, -1):
        own, contexts = levels[k]
        own = F.broadcast(own) if k <= 1 else own
        contexts = contexts.select("context", F.col("total").alias("own_total"), F.col("distinct").alias("own_distinct"), "left_total", "left_distinct")
        contexts = F.broadcast(contexts) if k <= 2 else contexts
        todo = todo.withColumn("key", F.col("gram") % 256 ** (k + 1)).withColumn("context", F.shiftright("key", 8))
        met = todo.join(own, "key", "left").join(contexts, "context", "left")
        total, distinct = F.coalesce("total", "own_total"), F.coalesce("distinct", "own_distinct")
        step = F.when(F.col("n").isNotNull(), F.log10("n") - F.log10(total + distinct)).when(distinct > 0, F.log10(distinct / (total + distinct))).otherwise(0.0)
        met = met.select("gram", (F.col("log") + step).alias("log"), F.col("n").isNotNull().alias("known"), F.col("left_total").alias("total"), F.col("left_distinct").alias("distinct"))
        met = settle(met, f"lm-met-{k}")
        done.append(met.filter("known").select("gram", "log"))
        todo = met.filter("not known").drop("known")
    never = math.log10(max(256 - levels[0][0].count(), 1))
    done.append(todo.select("gram", (F.col("log") - never).alias("log")))
    return reduce(DataFrame.unionAll, done)


def frequent(levels: list[tuple[DataFrame, DataFrame]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` grams of the longest order with their scores: the most frequent, by a threshold on their count."""
    own, contexts = levels[-1]
    sizes = own.groupBy("n").count().orderBy(F.desc("n")).limit(100_000).toArrow().to_pandas()
    fits = sizes["n"][sizes["count"].cumsum() <= most]
    if not len(fits):
        return np.zeros(0, np.int64), np.zeros(0)
    # a known gram's context is known with it
    both = own.filter(F.col("n") >= int(fits.min())).withColumn("context", F.shiftright("key", 8)).join(contexts, "context")
    told = both.select("key", (F.log10("n") - F.log10(F.col("total") + F.col("distinct"))).alias("log")).toArrow()
    return told["key"].to_numpy(), told["log"].to_numpy()


def score(docs: DataFrame, folds: int = 10, order: int = ORDER, most: int = MOST_GRAMS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    marked = texts(docs).withColumn("held_out", F.coalesce(fold_of(F.col("doc_id"), folds) == 0, F.lit(False)))
    told = settle(marked.filter("not held_out").select("text").mapInPandas(_count, "word string, gram long, n long"), "lm-counts")
    counts = settle(told.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    below = whole["n"] + ALPHA * (whole["v"] + 1)
    sizes = counts.groupBy("n").count().orderBy(F.desc("n")).limit(MOST_WORDS).toArrow().to_pandas()
    fits = sizes["n"][sizes["count"].cumsum() <= MOST_WORDS]
    least = int(fits.min()) if len(fits) else None
    common = counts.filter(F.col("n") >= least).toArrow().to_pandas() if least is not None else pd.DataFrame({"word": [], "n": []})
    words = dict(zip(common["word"], (math.log10((c + ALPHA) / below) for c in common["n"]), strict=True))
    del common
    levels = trie(told.filter("gram is not null").select("gram", "n"), order)
    shared = spark.sparkContext.broadcast(Shared(*frequent(levels, most), words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value.words
        for batch in batches:
            scores, grams, times = zip(*(x for many in _chunks(batch["text"]) for x in shared.value.score(many, order)), strict=True) if len(batch) else ((), (), ())
            rows = []
            for t in batch["text"]:
                found = words_of(t)
                logs = list(map(known.get, found))
                logs.append(known.get(""))
                found.append("")
                hit = [x for x in logs if x is not None]
                rest = " ".join([w for w, x in zip(found, logs, strict=True) if x is None]) if len(hit) < len(logs) else None
                rows.append((len(found), len(hit), math.fsum(hit), rest))
            out = pd.DataFrame(rows, columns=["n_tokens", "hits", "hit_score", "rest"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out.assign(held_out=batch["held_out"].to_numpy(), known_score=scores, grams=grams, times=times)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = marked.mapInPandas(run, f"doc_id {kind}, n_tokens long, hits long, hit_score double, rest string, held_out boolean, known_score double, grams array<long>, times array<long>")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rest = scored.filter("rest is not null").select("row", F.explode(F.split("rest", " ")).alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    # the broadcast words are known to be elsewhere
    rare = counts.filter(F.col("n") < least) if least is not None else counts
    seen = rest.join(rare, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + ALPHA) / below)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found")
    )
    apart = scored.filter("grams is not null").select("row", F.explode(F.arrays_zip("grams", "times")).alias("x")).select("row", "x.grams", "x.times").withColumnRenamed("grams", "gram")
    told = settle(log10(apart.select("gram").distinct(), levels), "lm-logs")
    others = apart.join(told, "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("other_score"))
    out = scored.join(seen, "row", "left").join(others, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(whole["n"]).cast("long").alias("train_tokens"),
        (F.col("hit_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("known_score") + F.coalesce("other_score", F.lit(0.0))).alias("score"),
    )
