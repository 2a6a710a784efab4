"""Names brought to a vocabulary, and selections and scores of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import series


def noisy_variants(vocabulary: DataFrame, name: str) -> DataFrame:
    """Spellings of each name: case, punctuation and suffixes."""
    v = F.col(name)
    return vocabulary.select(name, F.explode(F.array_distinct(F.array(v, F.upper(v), F.lower(v), F.concat(v, F.lit(".")), F.concat(F.lit("- "), v), F.concat(v, F.lit(" (serum)"))))).alias("raw"))


def char_grams(df: DataFrame, key: str, text: str, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """(key, gram, n) over each text between marks."""
    s = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    grams = F.flatten(F.array(*(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i, k=k: F.substring(s, i, F.lit(k))) for k in sizes)))
    return df.select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def normalise_terms(raw: DataFrame, vocabulary: DataFrame, least: float = 0.55) -> DataFrame:
    """raw (id, name), vocabulary (alias, label): the exact alias, else the nearest alias by cosine of tf-idf character
    grams; below ``least`` unknown. Only aliases that share a gram are compared."""
    exact = raw.join(vocabulary, F.lower("name") == F.lower("alias"), "left").groupBy("id", "name").agg(F.min("label").alias("exact"))
    v = char_grams(vocabulary.select(F.col("alias").alias("key"), F.col("alias").alias("t")), "key", "t")
    n = vocabulary.agg(F.countDistinct("alias").alias("docs"))
    idf = v.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weigh = lambda g: g.join(idf, "gram").withColumn("w", F.col("n") * F.col("idf")).withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key"))))
    left = weigh(char_grams(exact.filter("exact is null").select(F.col("id").alias("key"), F.col("name").alias("t")), "key", "t")).select(F.col("key").alias("id"), "gram", (F.col("w") / F.col("norm")).alias("a"))
    right = weigh(v).select(F.col("key").alias("alias"), "gram", (F.col("w") / F.col("norm")).alias("b"))
    near = left.join(right, "gram").groupBy("id", "alias").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("score")).join(vocabulary, "alias")
    best = near.groupBy("id").agg(F.max_by(F.struct("label", "score"), F.struct("score", "label")).alias("r")).select("id", "r.*")
    out = exact.join(best, "id", "left")
    label = F.coalesce("exact", F.when(F.col("score") >= least, F.col("label")), F.lit("unknown"))
    return out.select("id", label.alias("label"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


# --- selection, facts, claims ---
def compare_periods(df: DataFrame, start: str, end: str, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """The rows nearest to two dates; roles period_start and period_end."""
    gap = lambda d: F.abs(series.micros("ts") - F.lit(d).cast("timestamp").cast("long") * 1_000_000)
    row = F.struct("evidence_id", "ts", "value")
    agg = df.groupBy(*keys).agg(F.min_by(row, F.struct(gap(start), F.col("ts"), F.col("evidence_id"))).alias("a"), F.min_by(row, F.struct(gap(end), F.col("ts"), F.col("evidence_id"))).alias("b"))
    rows = F.array_distinct(F.array(F.struct(F.col("a.evidence_id").alias("evidence_id"), F.col("a.value").alias("value")), F.struct(F.col("b.evidence_id").alias("evidence_id"), F.col("b.value").alias("value"))))
    return agg.select(*keys, F.posexplode(rows).alias("place", "r")).select(*keys, "r.*", F.when(F.col("place") == 0, "period_start").otherwise("period_end").alias("role"))


def cite_facts(told: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """Facts whose contributors are within a claim's citations, or the other way round."""
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    return told.join(facts, on).filter(inside("contributors", "cited") | inside("cited", "contributors"))


def intent_score(df: DataFrame, abnormal: Column, first_only: bool, keys: Sequence[str] = series.KEYS) -> DataFrame:
    """1 for abnormal rows; where the first is asked for, 1 for it and 0.5 for later ones."""
    bad = F.coalesce(abnormal, F.lit(False))
    if not first_only:
        return df.select(*keys, "evidence_id", F.when(bad, 1.0).otherwise(0.0).alias("s_intent"))
    first = F.min(F.when(bad, F.struct("ts", "evidence_id"))).over(series.whole(keys))
    return df.select(*keys, "evidence_id", F.when(bad & (F.struct("ts", "evidence_id") == first), 1.0).when(bad, 0.5).otherwise(0.0).alias("s_intent"))
