"""Evaluation of packages, extraction, grounding and ablations; small text helpers of the retrieval path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, series


def _share(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def package_metrics(gold: DataFrame, chosen: DataFrame) -> DataFrame:
    """gold (query_id, id, is_primary), chosen (query_id, id, is_primary) -> per query: precision, recall and F1 of primary rows,
    and the share of all gold rows that the package covers."""
    g, c = gold.withColumnRenamed("is_primary", "gp"), chosen.withColumnRenamed("is_primary", "cp")
    per = g.join(c, ["query_id", "id"], "full_outer").groupBy("query_id").agg(
        F.count_if(F.col("gp") & F.col("cp")).alias("hit"), F.count_if("gp").alias("n_gold"), F.count_if("cp").alias("n_chosen"), F.count_if(F.col("gp").isNotNull() & F.col("cp").isNotNull()).alias("covered"), F.count("gp").alias("all_gold")
    )
    return per.select("query_id", _share(F.col("hit"), F.col("n_chosen")).alias("precision"), _share(F.col("hit"), F.col("n_gold")).alias("recall"), _share(2 * F.col("hit"), F.col("n_gold") + F.col("n_chosen")).alias("f1"), _share(F.col("covered"), F.col("all_gold")).alias("coverage"))


def diagnose(ranked: DataFrame, gold: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Per query: perfect when all gold ids are in the top k, unreachable when one isn't in the corpus, missing when one
    isn't ranked at all, else a ranking error."""
    g = gold.join(corpus.select("id", F.lit(True).alias("known")), "id", "left").join(ranked.select("query_id", "id", "rank"), ["query_id", "id"], "left")
    per = g.groupBy("query_id").agg(F.count_if(F.col("rank") <= k).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("lost"), F.count_if(F.col("rank").isNull()).alias("unranked"))
    return per.select("query_id", F.when(F.col("top") == F.col("n"), "perfect").when(F.col("lost") > 0, "unreachable").when(F.col("unranked") > 0, "missing").otherwise("ranking_error").alias("diagnosis"))


def term_accuracy(df: DataFrame, truth: str, guesses: str, known: Column, k: int = 3) -> DataFrame:
    """Top-1 and top-k accuracy over known terms, and how often unknown ones are left unknown. ``guesses``: array, best first."""
    first = F.coalesce(F.get(guesses, F.lit(0)), F.lit("unknown"))
    return df.agg(
        _share(F.count_if(known & (first == F.col(truth))), F.count_if(known)).alias("top1"), _share(F.count_if(known & F.array_contains(F.slice(guesses, 1, k), F.col(truth))), F.count_if(known)).alias("topk"),
        _share(F.count_if(~known & (first == "unknown")), F.count_if(~known)).alias("unknown"),
    )


def field_metrics(gold: DataFrame, found: DataFrame, within: float = 0.051) -> DataFrame:
    """gold and found (doc, field, value): precision, recall, F1 with a tolerance on values, exact documents."""
    both = gold.withColumnRenamed("value", "g").join(found.withColumnRenamed("value", "f"), ["doc", "field"], "full_outer")
    ok = F.coalesce(F.abs(F.col("g") - F.col("f")) <= within, F.lit(False))
    per = both.groupBy("doc").agg(F.count_if(ok).alias("hit"), F.count("g").alias("g"), F.count("f").alias("f"))
    exact = (F.col("hit") == F.col("g")) & (F.col("hit") == F.col("f"))
    return per.agg(_share(F.sum("hit"), F.sum("f")).alias("precision"), _share(F.sum("hit"), F.sum("g")).alias("recall"), _share(2 * F.sum("hit"), F.sum("g") + F.sum("f")).alias("f1"), _share(F.count_if(exact), F.count(F.lit(1))).alias("exact"))


def grounding_rates(checked: DataFrame, group: str) -> DataFrame:
    """Shares of grounded and of hallucinated claims, overall and by group."""
    return checked.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("grounded").cast("int")), 6).alias("grounded"), F.round(F.avg((F.col("n_loose") > 0).cast("int")), 6).alias("hallucinated"), F.grouping(group).alias("overall"))


def ablation(truth: DataFrame, key: str, methods: dict[str, DataFrame], baseline: str, gain: float = 0.02, cost: float = 0.05) -> DataFrame:
    """Methods (key, alarm) against labels (key, is_anomaly): F1 and false-alarm rate of each, and whether it is better than the
    baseline by ``gain`` without ``cost`` more false alarms."""
    told = None
    for name, df in methods.items():
        one = df.select(key, F.coalesce("alarm", F.lit(False)).alias("alarm"), F.lit(name).alias("method"))
        told = one if told is None else told.unionByName(one)
    scored = metrics.binary(told.join(truth, key), F.col("is_anomaly"), F.col("alarm"), ["method"]).withColumn("far", F.round(1 - F.col("specificity"), 6))
    base = scored.filter(F.col("method") == baseline).select(F.col("f1").alias("bf"), F.col("far").alias("br"))
    return scored.crossJoin(base).select("method", "f1", "far", ((F.col("f1") - F.col("bf") >= gain) & (F.col("far") - F.col("br") <= cost)).alias("promoted"))


def answer_rates(df: DataFrame, text: str, cited: Column, words: Sequence[str], tone: Column) -> DataFrame:
    """Shares of answers that hold a keyword, cite something, and break the tone."""
    low = F.lower(text)
    hit = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return df.agg(rate(hit, "keyword"), rate(cited, "cited"), rate(tone, "tone_broken"))


def feature_summary(df: DataFrame, n: int, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """Trajectory features of each series' last n rows."""
    return series.trajectory_features(series.last_n(df, n, keys).drop("role"), keys)


def scaled_contributions(df: DataFrame, columns: Sequence[str], key: Sequence[str], k: int = 2) -> DataFrame:
    """The k features of each row that lie farthest from the middle, in interquartile ranges."""
    from .cohort import impute_and_scale

    scaled = impute_and_scale(df, columns, key)
    rows = F.array(*(F.struct((-F.abs(F.col(c))).alias("by"), F.lit(c).alias("feature"), F.col(c).alias("scaled")) for c in columns))
    return scaled.select(*key, F.inline(F.slice(F.array_sort(rows), 1, k))).select(*key, "feature", "scaled")


def normalise_units(df: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """The row's own unit, trimmed; else the usual one of its analyte."""
    return df.join(units.withColumnRenamed("unit", "usual"), key, "left").withColumn("unit", F.coalesce(F.nullif(F.trim("unit"), F.lit("")), "usual")).drop("usual")


def build_query_text(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """A question's text with its analyte's synonyms after it."""
    s = synonyms.groupBy("analyte").agg(F.array_join(F.array_sort(F.collect_set("synonym")), " ").alias("more"))
    return queries.join(s, "analyte", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))


def definition_lookup(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """"what is X": the first sentence "X is ..." of the least document that has one. Documents are cut into sentences keyed by
    their subject, so the lookup is an equality join."""
    q = questions.select("query_id", F.lower(F.regexp_extract("text", r"(?i)^what (?:is|are) (?:a |an |the )?([A-Za-z0-9-]+)", 1)).alias("subject")).filter("subject <> ''")
    s = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?:^|[.!?]\s+)([A-Za-z0-9-]+ (?:is|are|measures) [^.!?]*[.!?])"), F.lit(1))).alias("at", "sentence"))
    s = s.withColumn("subject", F.lower(F.regexp_extract("sentence", r"^([A-Za-z0-9-]+)", 1)))
    first = s.join(q.select("subject").distinct(), "subject", "left_semi").groupBy("subject").agg(F.min_by("sentence", F.struct("doc_id", "at")).alias("sentence"))
    return q.join(first, "subject").select("query_id", "subject", "sentence")
