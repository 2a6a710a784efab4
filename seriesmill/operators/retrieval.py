"""Text tables and ranked retrieval: chunks, BM25, vectors, fusion, rules. Scores are tables (query, id, score)."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import scalar
from ..session import scratch


def chunks(df: DataFrame, key: str, text: str, size: int = 300, overlap: int = 50) -> DataFrame:
    """Overlapping word windows of each text; the last may be short."""
    step = size - overlap
    words = df.select(key, F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))
    rows = words.filter(F.size("w") > 0).select(key, "w", F.posexplode(starts).alias("chunk", "at"))
    return rows.select(key, "chunk", F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("text"))


def postings(df: DataFrame, key: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """(key, carried columns, term, tf, length)."""
    words = df.select(key, *carry, scalar.tokenize(F.col(text)).alias("w"))
    terms = words.select(key, *carry, F.size("w").alias("length"), F.explode("w").alias("term"))
    return terms.groupBy(key, *carry, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, scope: Sequence[str] = ()) -> DataFrame:
    """queries (query_id, text), docs (doc_id, text) -> query_id, doc_id, score: Okapi BM25 with the smoothed idf
    ln(1 + (N - df + 0.5) / (df + 0.5)). Only postings of query terms meet a query; repeated query terms count. With
    ``scope`` columns on both sides, a query meets the documents of its own scope, and all statistics are the scope's."""
    if not scope:
        return term_scores(queries, docs, {"score": "bm25"}, k1, b)
    at, term = list(scope), [*scope, "term"]
    sized = docs.select("doc_id", *at, F.size(scalar.tokenize(F.col("text"))).alias("n"))
    whole = sized.groupBy(*at).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_length"))
    terms = postings(queries, "query_id", "text", at).select("query_id", *term, F.col("tf").alias("qtf"))
    found = postings(docs, "doc_id", "text", at).join(terms.select(*term).distinct(), term, "left_semi")
    # counted by tf, so that both uses of the postings have the same columns and share one shuffle
    freq = found.groupBy(*term).agg(F.count_if(F.col("tf") > 0).alias("df"))
    met = found.join(freq, term).join(terms, term).join(whole, at)
    return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(_okapi(k1, b)), 6).alias("score"))


def _okapi(k1: float, b: float) -> Column:
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))


def kept(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back, where several plans read it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Terms of queries that are broadcast; with more of them, postings and terms are shuffled.
MOST_TERMS = 500_000


def term_scores(queries: DataFrame, docs: DataFrame, names: dict[str, str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id and a column for each of ``names`` (column -> bm25, or coverage: the share of a query's distinct terms that a
    document holds) for each query and document with a common term. Texts are read once: postings of query terms are kept, and
    with them, as the term '', how many documents have an id and a length. What a document's terms add up to is
    summed where its postings are, so rows of (query, document, term) aren't shuffled."""
    terms = kept(postings(queries, "query_id", "text").select("query_id", "term", F.col("tf").alias("qtf")), "terms")
    few = F.broadcast if terms.limit(MOST_TERMS + 1).count() <= MOST_TERMS else lambda df: df
    wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(""))).distinct()
    words = docs.select("doc_id", scalar.tokenize(F.col("text")).alias("w"))
    each = words.select("doc_id", F.size("w").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.coalesce("w", F.array().cast("array<string>")))).alias("term"))
    counted = each.join(few(wanted), "term", "left_semi").groupBy("doc_id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))
    every = kept(counted, "postings")
    # one row: the corpus' totals; a text that is null counts as a document, without a length
    sized = F.when(F.col("length") >= 0, F.col("tf"))
    whole = every.filter("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("length").cast("double") * sized) / F.sum(sized)).alias("avg_length"))
    found = every.filter("term <> ''")
    asked = terms.withColumn("asked", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    weights = asked.join(found.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").crossJoin(F.broadcast(whole))
    met = found.repartition("doc_id").join(few(weights), "term")
    made = {"bm25": F.sum(_okapi(k1, b)), "coverage": F.count(F.lit(1)) / F.max("asked")}
    return met.groupBy("query_id", "doc_id").agg(*(F.round(made[kind], 6).alias(c) for c, kind in names.items()))


#: Vectors and queries of a block of pairs, and numbers of a product that a task holds at once.
PART, TOGETHER, PRODUCT = 8192, 8192, 1 << 19


def _best(k: int):
    """Of a block of queries and one of vectors (id, e, size): each query's k best by the exact score, ties by id, with all that could tie
    once scores are rounded to six places."""

    def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sums in the order of the components, so that the last bit doesn't depend on how rows are dealt."""
        s = np.zeros(a.shape[1])
        for x, y in zip(a, b, strict=True):
            s = s + x * y
        return s

    def unit(e: pd.Series) -> np.ndarray:
        """Vectors in length 1, by row."""
        matrix = np.stack(e.to_numpy()).astype(float)
        with np.errstate(all="ignore"):
            return matrix / np.maximum(np.sqrt(fold(matrix.T, matrix.T)), 1e-12)[:, None]

    def run(ask: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "raw": np.zeros(0), "known": np.zeros(0, bool)})]
        for size, some in ask.groupby("size"):
            same = (own["size"] == size) & (size >= 0)
            q, i = some["id"].to_numpy(), own["id"].to_numpy()[same]
            # pairs without a score come last, by id
            rest = np.sort(own["id"].to_numpy()[~same])
            rest = rest[: k + np.unique(rest, return_counts=True)[1].max(initial=0)]
            out.append(pd.DataFrame({"query_id": np.repeat(q, len(rest)), "vec_id": np.tile(rest, len(q)), "raw": 0.0, "known": False}).query("query_id != vec_id"))
            if not len(i):
                continue
            order = np.argsort(i, kind="stable")
            i, matrix, asked = i[order], unit(own["e"][same].iloc[order]), unit(some["e"])
            columns = np.ascontiguousarray(matrix.T)
            for at in range(0, len(q), step := max(1, PRODUCT // len(i))):
                part = asked[at : at + step]
                with np.errstate(all="ignore"):
                    score = np.nan_to_num(part @ matrix.T, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                # a query's own row may be among its best, even several times
                score[q[at : at + step, None] == i] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] - 2e-6 if len(i) > k else np.full(len(score), -np.inf)
                a, b = np.nonzero((score >= least[:, None]) & (q[at : at + step, None] != i))
                with np.errstate(all="ignore"):
                    raw = np.concatenate([fold(part.T[:, a[f : f + PART]], columns[:, b[f : f + PART]]) for f in range(0, max(len(a), 1), PART)])
                found = pd.DataFrame({"query_id": q[at + a], "vec_id": i[b], "raw": raw, "known": True})
                # copies have one score: the k least ids of each are enough
                out.append(found[found.groupby(["query_id", "raw"], dropna=False).cumcount() < k])
        return pd.concat(out)

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact cosine top-k. Every block of queries meets every block of vectors once, by a product in pieces of bounded size, and only each
    block's k best go on to the last ranking."""

    def sized(df: DataFrame) -> DataFrame:
        e = F.col("embedding")
        whole = e.isNotNull() & F.forall(e, lambda x: x.isNotNull())
        return df.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("id"), F.when(whole, e).alias("e"), F.when(whole, F.size(e)).otherwise(-1).alias("size"))

    blocks = lambda df, most: -(-df.count() // most) or 1
    nq, nv = blocks(queries, TOGETHER), blocks(vectors, PART)
    number = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q, v = sized(queries).withColumn("qb", number(nq)).withColumn("vb", every(nv)), sized(vectors).withColumn("vb", number(nv)).withColumn("qb", every(nq))
    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(_best(k), "query_id long, vec_id long, raw double, known boolean")
    # a score that isn't a number comes back from pandas as null
    scored = found.select("query_id", "vec_id", F.when(F.col("known"), F.round(F.coalesce("raw", F.lit(float("nan"))), 6)).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


#: Weights of the five scores by preset, fixed values: lexical, semantic, concept, temporal, intent.
PRESETS = {
    "bm25": (1.0, 0.0, 0.0, 0.0, 0.0),
    "dense": (0.0, 1.0, 0.0, 0.0, 0.0),
    "hybrid": (0.5, 0.5, 0.0, 0.0, 0.0),
    "hybrid_temporal": (0.35, 0.35, 0.0, 0.30, 0.0),
    "rrf": (0.5, 0.5, 0.0, 0.0, 0.0),
    "rrf_temporal": (0.35, 0.35, 0.0, 0.30, 0.0),
    "hybrid_temporal_concept": (0.25, 0.25, 0.25, 0.25, 0.0),
    "full": (0.20, 0.20, 0.25, 0.25, 0.10),
}
SCORES = ("lexical", "semantic", "concept", "temporal", "intent")


def preset(name: str) -> dict[str, float]:
    """Score column -> weight, those without weight left out."""
    return {c: w for c, w in zip(SCORES, PRESETS[name], strict=True) if w}


def fuse_columns(scored: DataFrame, weights: dict[str, float], i: str = "doc_id") -> DataFrame:
    """Like ``fuse_weighted`` where the scores are columns of one table, null where one lacks the id. A query's greatest scores are an
    aggregate, so its rows need not come together; ``scored`` is read twice."""
    used = {c: w for c, w in weights.items() if w}
    tops = scored.groupBy(F.col("query_id").alias("q_")).agg(*(F.max(c).alias(f"top_{n}") for n, c in enumerate(used)))
    few = tops.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES
    both = scored.join(F.broadcast(tops) if few else tops, F.col("query_id").eqNullSafe(F.col("q_")))
    part = lambda n, c: F.when(F.col(f"top_{n}") > 0, F.col(c) / F.col(f"top_{n}")).otherwise(0.0)
    parts = [F.coalesce(part(n, c), F.lit(0.0)) * w for n, (c, w) in enumerate(used.items())]
    return both.select("query_id", i, F.round(sum(parts, F.lit(0.0)), 6).alias("score"))


#: Queries whose candidates are counted against all rows at once; with more, each query's rows are ranked, as many queries
#: share the work.
MOST_QUERIES = 2000


def fuse_rank_columns(scored: DataFrame, columns: Sequence[str], k: int = 60, i: str = "doc_id", most: int | None = None) -> DataFrame:
    """Reciprocal rank fusion where the scores are columns of one table. An id without a score has the rank after all rows of
    its query. With ``most``, only rows that can be among a query's ``most`` best are told, with the same scores; ids must
    be unique in a query then, and ``scored`` is read several times."""
    if most and all(dict(scored.dtypes)[c] in ("float", "double") for c in columns) and scored.select("query_id").distinct().limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return _best_by_rank(scored.select("query_id", i, *columns), columns, k, i, most)
    w = Window.partitionBy("query_id")
    after = F.count(F.lit(1)).over(w) + 1
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last(c), i))).otherwise(after)
    return scored.select("query_id", i, F.round(sum((1.0 / (k + rank(c)) for c in columns), F.lit(0.0)), 8).alias("score"))


def _best_by_rank(rows: DataFrame, columns: Sequence[str], k: int, i: str, most: int) -> DataFrame:
    """A row beyond the first m (k + most) - k of each of m columns has less than 1 / (k + most), which a column's first ``most`` have at
    least. So only the first ones of each column can be best. Their ranks in the other columns are counts of the rows ahead of them,
    taken where the rows are."""
    w, deep = Window.partitionBy("query_id"), len(columns) * (k + most) - k
    first = [rows.withColumn("at_", F.row_number().over(w.orderBy(F.desc_nulls_last(c), i))).filter(F.col("at_") <= deep).drop("at_") for c in columns]
    own = reduce(DataFrame.union, first).distinct().collect()
    local = rows.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(own)], StructType([StructField("no_", IntegerType()), *rows.schema.fields]))
    # by query and column the candidates with a score, from the last to the first: their scores, ids and numbers; a null id is the first of its score
    place = lambda x: (x is not None, x)
    asked: dict = {}
    for n, r in enumerate(own):
        asked.setdefault(r["query_id"], []).append((n, r[i], *(r[c] for c in columns)))
    limits = {}
    for q, some in asked.items():
        for j in range(len(columns)):
            order = sorted((x for x in some if x[j + 2] is not None), key=lambda x: place(x[1]), reverse=True)
            order = [order[x] for x in np.argsort(np.array([x[j + 2] for x in order], float), kind="stable")]
            limits[q, j] = np.array([x[j + 2] for x in order], float), [place(x[1]) for x in order], np.array([x[0] for x in order], int)

    def behind(x: np.ndarray, ids, top: np.ndarray, own_ids: list) -> np.ndarray:
        """Of each row, how many candidates it is ahead of; among equal scores the lesser id is ahead."""
        low, high = np.searchsorted(top, x, "left"), np.searchsorted(top, x, "right")
        for at in np.flatnonzero(low < high):
            low[at] = bisect.bisect_left(own_ids, 0, low[at], high[at], key=lambda other, mine=place(ids[at].as_py()): -1 if other > mine else 0)
        return low

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {key: np.zeros(len(top) + 1, np.int64) for key, (top, _, _) in limits.items()}

        def add(table: pa.Table) -> None:
            code = table["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
            number, names, ids = code.indices.to_numpy(), code.dictionary.to_pylist(), table[i].combine_chunks()
            order = np.argsort(number, kind="stable")
            ends = np.searchsorted(number[order], np.arange(len(names) + 1))
            for j, c in enumerate(columns):
                there = table[c].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
                x = table[c].combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False).astype(float)
                for q, a, b in zip(names, ends[:-1], ends[1:], strict=True):
                    at = order[a:b][there[order[a:b]]]
                    top, own_ids, _ = limits[q, j]
                    found[q, j] += np.bincount(behind(x[at], ids.take(pa.array(at)), top, own_ids), minlength=len(top) + 1)

        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + len(batch)
            if size >= TOGETHER * 32:
                add(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            add(pa.Table.from_batches(held))
        told = [(int(n), j, int(x)) for (q, j), (_, _, numbers) in limits.items() for n, x in zip(numbers, np.cumsum(found[q, j][::-1])[::-1][1:], strict=True) if x]
        yield pa.RecordBatch.from_pydict({name: pa.array([t[at] for t in told], kind) for at, (name, kind) in enumerate((("no_", pa.int32()), ("by_", pa.int32()), ("n_", pa.int64())))})

    ahead = rows.mapInArrow(count, "no_ int, by_ int, n_ long").groupBy("no_").agg(*(F.sum(F.when(F.col("by_") == j, F.col("n_"))).alias(f"n{j}_") for j in range(len(columns))))
    sizes = rows.groupBy(F.col("query_id").alias("q_")).agg(F.count(F.lit(1)).alias("rows_"))
    both = local.join(ahead, "no_", "left").join(sizes, F.col("query_id").eqNullSafe(F.col("q_")))
    rank = lambda j, c: F.when(F.col(c).isNotNull(), F.coalesce(f"n{j}_", F.lit(0)) + 1).otherwise(F.col("rows_") + 1)
    return both.select("query_id", i, F.round(sum((1.0 / (k + rank(j, c)) for j, c in enumerate(columns)), F.lit(0.0)), 8).alias("score"))


def fuse_weighted(tables: Sequence[tuple[DataFrame, float]], i: str = "doc_id") -> DataFrame:
    """Sum of max-scaled scores by weight; parts without weight are left out of the plan."""
    parts = [t.select("query_id", i, (scalar.max_scale("score", "query_id") * w).alias("part")) for t, w in tables if w]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", i).agg(F.round(F.sum("part"), 6).alias("score"))


def fuse_rrf(tables: Sequence[DataFrame], k: int = 60, i: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion; an id that a table of n rows for the query lacks has rank n + 1 there."""
    ranked = []
    for n, t in enumerate(tables):
        w = Window.partitionBy("query_id")
        ranked.append(t.select("query_id", i, F.row_number().over(w.orderBy(F.desc("score"), i)).alias("r"), F.lit(n).alias("part")))
    both = ranked[0]
    for r in ranked[1:]:
        both = both.unionByName(r)
    sizes = both.groupBy("query_id").agg(*(F.count_if(F.col("part") == n).alias(f"n{n}") for n in range(len(tables))))
    per = both.groupBy("query_id", i).agg(*(F.max(F.when(F.col("part") == n, F.col("r"))).alias(f"r{n}") for n in range(len(tables))))
    score = sum((1.0 / (k + F.coalesce(F.col(f"r{n}"), F.col(f"n{n}") + 1)) for n in range(len(tables))), F.lit(0.0))
    return per.join(sizes, "query_id").select("query_id", i, F.round(score, 8).alias("score"))


def match_rules(df: DataFrame, key: str, text: str, rules: Sequence[tuple[int, str, str]]) -> DataFrame:
    """First category whose expression occurs; rules (order, category, expression), tried in order."""
    out = None
    for _, category, pattern in sorted(rules):
        test = F.col(text).rlike(pattern)
        out = F.when(test, category) if out is None else out.when(test, category)
    return df.select(key, out.alias("category"))


def detect_topics(df: DataFrame, key: str, text: str, topics: dict[str, Sequence[str]]) -> DataFrame:
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*(F.when(low.rlike("|".join(words)), F.lit(t)) for t, words in sorted(topics.items()))))
    return df.select(key, hits.alias("topics"))


def topic_boost(a: Column, b: Column, each: float = 0.15, most: float = 0.35) -> Column:
    return F.least(F.size(F.array_intersect(a, b)) * each, F.lit(most))


def concept_score(code: Column, concept: Column, name: Column, alias: Column, asked: Column) -> Column:
    """1 by code or concept, 0.95 by name, 0.9 by alias, 0.5 where nothing is asked, else 0."""
    return F.when(asked.isNull(), 0.5).when((code == asked) | (concept == asked), 1.0).when(name == asked, 0.95).when(alias == asked, 0.9).otherwise(0.0)


def contains_join(queries: DataFrame, names: DataFrame, most_names: int = 100_000) -> DataFrame:
    """Names that occur in a question: candidates share the name's first token, containment decides. Names are counted and
    broadcast while they are few; beyond that tokens alone are shuffled, and a text meets its candidates by id. Texts
    spread out by token are never broadcast nor shuffled."""
    n = names.select("name", F.lower("name").alias("low_name"), F.regexp_extract(F.lower("name"), "[a-z0-9]+", 0).alias("tok"))
    texts = queries.select("query_id", F.lower("text").alias("low"))
    tokens = F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))
    if names.limit(most_names + 1).count() <= most_names:
        met = texts.select("query_id", "low", F.explode(tokens).alias("tok")).join(F.broadcast(n), "tok")
    else:
        told = texts.select("query_id", F.explode(tokens).alias("tok")).join(n.hint("shuffle_hash"), "tok").distinct()
        # ids may repeat: each text must hold the token itself
        met = told.withColumnRenamed("query_id", "q_").join(texts.hint("merge"), F.col("q_").eqNullSafe(F.col("query_id"))).filter(F.array_contains(tokens, F.col("tok")))
    return met.filter(F.contains("low", "low_name")).select("query_id", "name").distinct()


def rerank(results: DataFrame, roles: DataFrame, longitudinal: Column, weight: float = 0.25) -> DataFrame:
    """(1 - w) score + w role score for longitudinal questions; a zero stays zero."""
    both = results.join(roles, "evidence_id", "left")
    mixed = (1 - weight) * F.col("score") + weight * F.coalesce("role_score", F.lit(0.5))
    return both.withColumn("score", F.round(F.when((F.col("score") > 0) & longitudinal, mixed).otherwise(F.col("score")), 6))


def gram_tfidf(texts: DataFrame, keys: Sequence[str], sizes: Sequence[int] = (3, 4, 5), most: int = 4096) -> DataFrame:
    """texts (``keys``, text) -> keys, gram, weight: vectors over the ``most`` commonest character grams, of length 1. Grams are taken of
    each lower-cased word between two blanks; weights are (1 + ln count) times the smoothed inverse document frequency. The
    cosine of two texts is the sum of products over shared grams. Null and empty texts have no rows, but count as texts;
    only the ``most`` grams kept are broadcast."""

    def spelled(words: DataFrame) -> DataFrame:
        """A row for each gram of word_, which stays a column: within lambda functions it would be put together anew for each gram."""
        sized = words.withColumn("size_", F.explode(F.array(*map(F.lit, sizes)))).filter(F.length("word_") >= F.col("size_"))
        placed = sized.withColumn("at_", F.explode(F.sequence(F.lit(1), F.length("word_") - F.col("size_") + 1)))
        return placed.withColumn("gram", F.substr("word_", F.col("at_"), F.col("size_"))).drop("word_", "size_", "at_")

    words = texts.select(*keys, F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word_")).filter("word_ <> ''").withColumn("word_", F.concat(F.lit(" "), "word_", F.lit(" ")))
    # the commonest are counted by word, and only they are counted by text
    common = spelled(words.groupBy("word_").agg(F.count(F.lit(1)).alias("n"))).groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(most).select("gram")
    counts = spelled(words.repartition(*keys)).join(F.broadcast(common), "gram", "left_semi").groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count(F.lit(1)).alias("texts"))
    idf = kept.crossJoin(F.broadcast(total)).select("gram", (F.log((1 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(F.broadcast(idf), "gram").withColumn("w", (1 + F.log("n")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*keys)))
    return raw.select(*keys, "gram", F.round(F.col("w") / norm, 6).alias("weight"))
