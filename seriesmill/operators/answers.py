"""Questions answered from ranked texts: scorers plugged into one retrieval, and the answer with its sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from . import retrieval
from .relational import topk_positive

#: (queries, items) -> query_id, item id, score; at most one row for each pair.
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def term_coverage(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of a query's distinct terms that a document holds; pairs without a common term are left out."""
    return retrieval.term_scores(queries, docs, {"score": "coverage"})


#: Scorers that count common terms; those at hand read the texts together.
TERM_SCORERS: dict[Scorer, str] = {retrieval.bm25: "bm25", term_coverage: "coverage"}


def retrieve(
    queries: DataFrame, items: DataFrame, scorers: dict[str, Scorer], weights: dict[str, float], k: int, eligible: DataFrame | None = None, by_rank: bool = False, i: str = "doc_id"
) -> DataFrame:
    """query_id, item id, score, rank: the k best of each query. Only scorers with weight run; their scores become columns of
    one table, which is kept, fused by weight or by rank. ``eligible`` (item ids) gates what is fused, so scales don't depend on it."""
    used = [name for name, w in weights.items() if w]
    terms = {name: TERM_SCORERS[scorers[name]] for name in used if scorers[name] in TERM_SCORERS and i == "doc_id"}
    scored = retrieval.term_scores(queries, items, terms) if terms else None
    if len(terms) < len(used):
        told = [scored.select("query_id", i, F.lit(name).alias("by"), F.col(name).alias("score")) for name in terms]
        told += [scorers[name](queries, items).select("query_id", i, F.lit(name).alias("by"), "score") for name in used if name not in terms]
        columns = [F.max(F.when(F.col("by") == name, F.col("score"))).alias(name) for name in used]
        scored = reduce(DataFrame.unionByName, told).groupBy("query_id", i).agg(*columns)
    scored = retrieval.kept(scored, "scored")
    # where rows are gated after they are ranked, those behind the best may be needed
    fused = retrieval.fuse_rank_columns(scored, used, i=i, most=None if eligible is not None else k) if by_rank else retrieval.fuse_columns(scored, weights, i)
    if eligible is not None:
        fused = fused.join(eligible.select(i), i, "left_semi")
    return topk_positive(fused, "query_id", k, "score", i)


def answer_table(
    questions: DataFrame, docs: DataFrame, rules: Sequence[tuple[int, str, str]], replies: dict[str, str], most: int = 5, sentences: int = 3, none: str = "Too little is known to answer this."
) -> DataFrame:
    """questions (query_id, text), docs (doc_id, text, source) -> query_id, flagged, answer, citations (index, source).

    A question that a safety rule (order, category, expression) flags gets that category's reply and is never looked up.
    Others get the first sentences of their best texts, each with its source's number: the rank of the source's first text.
    A null source counts as one without a name. Without texts the answer is ``none``."""
    flagged = retrieval.match_rules(questions, "query_id", "text", rules)
    asked = questions.join(flagged.filter("category is null"), "query_id", "left_semi")
    best = topk_positive(retrieval.bm25(asked, docs), "query_id", most, "score", "doc_id")
    said = scalar.soften_tone(F.array_join(scalar.key_sentences(F.col("text"), sentences), " "))
    texts = docs.select("doc_id", said.alias("said"), F.coalesce("source", F.lit("")).alias("source"))
    # at most ``most`` rows a question
    found = best.join(texts, "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "said", "source"))).alias("found"))
    number = lambda source: F.array_min(F.transform(F.filter("found", lambda y: y["source"] == source), lambda y: y["rank"]))
    cited = F.array_sort(F.array_distinct(F.transform("found", lambda x: F.struct(number(x["source"]).alias("index"), x["source"].alias("source")))))
    found = found.withColumn("citations", cited)
    body = F.array_join(F.transform("found", lambda x: F.concat(x["said"], F.lit(" ["), number(x["source"]).cast("string"), F.lit("]"))), "\n\n")
    sources = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("["), c["index"].cast("string"), F.lit("] "), c["source"])), "\n")
    found = found.select("query_id", F.concat(body, F.lit("\n\nSources cited:\n"), sources).alias("body"), "citations")
    reply = F.coalesce(*(F.when(F.col("category") == c, F.lit(text)) for c, text in replies.items()), F.lit(none))
    return flagged.join(found, "query_id", "left").select(
        "query_id", F.col("category").isNotNull().alias("flagged"),
        F.when(F.col("category").isNotNull(), reply).otherwise(F.coalesce("body", F.lit(none))).alias("answer"),
        F.coalesce("citations", F.array().cast("array<struct<index:int,source:string>>")).alias("citations"),
    )
