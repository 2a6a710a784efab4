"""Evaluation metrics, all grouped: ranking, classification, regression, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def ranking(results: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """results (query_id, id, rank), gold (query_id, id) -> per query: reciprocal rank, recall, precision and hit at k, and
    nDCG at k against all relevant ids and against the retrieved ones."""
    n_gold = gold.groupBy("query_id").agg(F.countDistinct("id").alias("n_gold"))
    hits = results.join(gold.select("query_id", "id", F.lit(True).alias("hit")).distinct(), ["query_id", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return _ranked(hits, n_gold, k)


def ranking_by_label(results: DataFrame, queries: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """``ranking`` where all other ids with a query's label are relevant: queries (query_id), which are ids themselves, and labels (id,
    label). Relevant ids are counted by label, so that no table has a row for each query and relevant id. An id with several
    labels is relevant by any of them."""
    own = labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    sets = own.groupBy("labels").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.explode("labels"))
    # sets of labels that share one, each pair of sets once
    met = sets.select(F.col("labels").alias("asked"), "label").join(sets, "label").select("asked", "labels", "n").distinct().groupBy("asked").agg((F.sum("n") - 1).alias("n_gold"))
    asked = queries.select("query_id").distinct().join(own.select(F.col("id").alias("query_id"), F.col("labels").alias("asked")), "query_id")
    n_gold = asked.join(met, "asked").filter("n_gold > 0").select("query_id", "n_gold")
    both = results.join(asked, "query_id", "left").join(own, "id", "left")
    hit = F.coalesce(F.arrays_overlap("asked", "labels"), F.lit(False)) & (F.col("query_id") != F.col("id"))
    return _ranked(both.select("query_id", "id", "rank", hit.alias("hit")), n_gold, k)


def _ranked(hits: DataFrame, n_gold: DataFrame, k: int) -> DataFrame:
    gain = F.when(F.col("hit") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hits.groupBy("query_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.count_if(F.col("hit") & (F.col("rank") <= k)).alias("found"), F.count_if(F.col("rank") <= k).alias("returned"), F.sum(gain).alias("dcg")
    )
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    both = n_gold.join(per, "query_id", "left").na.fill(0, ["found", "returned"]).na.fill(0.0, ["dcg"])
    r = lambda c, n: F.round(c, 6).alias(n)
    return both.select(
        "query_id", r(F.coalesce(1 / F.col("first"), F.lit(0.0)), "rr"), r(_ratio(F.col("found"), F.col("n_gold")), "recall"), r(_ratio(F.col("found"), F.lit(k)), "precision"), (F.col("found") > 0).alias("hit"),
        r(F.col("dcg") / ideal(F.col("n_gold")), "ndcg"), r(F.when(F.col("found") > 0, F.col("dcg") / ideal(F.col("found"))).otherwise(0.0), "ndcg_retrieved"), r(_ratio(F.col("found"), F.col("returned")), "precision_returned"),
    )


def overall_and_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Means of all rows and of each group."""
    return df.rollup(group).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in columns), F.grouping(group).alias("overall"))


def binary(df: DataFrame, truth: Column, guess: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of the confusion table, precision, recall, F1, accuracy, specificity."""
    agg = df.groupBy(*keys).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    c = F.col
    r = lambda x, n: F.round(x, 6).alias(n)
    return agg.select(
        *keys, "tp", "fp", "fn", "tn", r(_ratio(c("tp"), c("tp") + c("fp")), "precision"), r(_ratio(c("tp"), c("tp") + c("fn")), "recall"), r(_ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")), "f1"),
        r(_ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "accuracy"), r(_ratio(c("tn"), c("tn") + c("fp")), "specificity"),
    )


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Mean F1 over the classes of either side, from one pass of pair counts."""
    pairs = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    t = pairs.groupBy(F.col(truth).alias("c")).agg(F.sum("n").alias("t"))
    g = pairs.groupBy(F.col(guess).alias("c")).agg(F.sum("n").alias("g"))
    h = pairs.filter(F.col(truth) == F.col(guess)).select(F.col(truth).alias("c"), F.col("n").alias("h"))
    f1 = 2.0 * F.coalesce("h", F.lit(0)) / (F.coalesce("t", F.lit(0)) + F.coalesce("g", F.lit(0)))
    return t.join(g, "c", "full_outer").join(h, "c", "left").agg(F.round(F.avg(f1), 6).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def roc_auc(df: DataFrame, truth: Column, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with average ranks, from counts per score; ties share their rank. Where one class lacks, 0.5."""
    per = df.groupBy(*keys, score).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"))
    per = running(per, [F.col(score)], ["q"], keys)
    agg = per.groupBy(*keys).agg(F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2.0)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return agg.select(*keys, F.round(F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("u") / (F.col("np") * F.col("nq"))).otherwise(0.5), 6).alias("auc"))


def pr_auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """Area under precision over recall by trapezoids, thresholds at distinct scores."""
    per = df.groupBy(score).agg(F.count_if(truth).alias("p"), F.count(F.lit(1)).alias("n"))
    every = per.agg(F.sum("p").alias("all"))
    run = running(per, [F.desc(score)], ["p", "n"]).crossJoin(F.broadcast(every))  # one row
    r0, p0 = F.col("p_before") / F.nullif("all", F.lit(0)), F.when(F.col("n_before") > 0, F.col("p_before") / F.col("n_before")).otherwise(1.0)
    r, p = (F.col("p_before") + F.col("p")) / F.nullif("all", F.lit(0)), (F.col("p_before") + F.col("p")) / (F.col("n_before") + F.col("n"))
    return run.agg(F.round(F.sum((r - r0) * (p + p0) / 2), 6).alias("pr_auc"))


def calibration_error(df: DataFrame, truth: Column, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("said"), F.avg(truth.cast("int")).alias("was"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))) / F.sum("n"), 6).alias("ece"))


def residual_calibration(df: DataFrame, y: str, guess: str, i: str, bins: int = 5) -> DataFrame:
    """Mean over bins of equal count, in order of the guess (ties by ``i``), of the size of the bin's mean residual; the first bins take
    the rows left over, bins without rows don't count, and an empty table gives 0. Rows without a value or a guess don't count."""
    rows = df.filter(F.col(y).isNotNull() & F.col(guess).isNotNull()).select(F.col(guess).cast("double").alias("g"), F.col(i).alias("i"), (F.col(y).cast("double") - F.col(guess).cast("double")).alias("e"), F.lit(1).alias("one"))
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    placed = running(rows, [F.col("g"), F.col("i")], ["one"]).crossJoin(F.broadcast(n))  # one row
    least, more, at = F.floor(F.col("n") / bins), F.col("n") % bins, F.col("one_before")
    edge = more * (least + 1)
    b = F.when(at < edge, F.floor(at / (least + 1))).otherwise(more + F.floor((at - edge) / F.greatest(least, F.lit(1))))
    per = placed.groupBy(b.alias("bin")).agg(F.abs(F.avg("e")).alias("bias"))
    return per.agg(F.round(F.coalesce(F.avg("bias"), F.lit(0.0)), 6).alias("residual_error"), F.count(F.lit(1)).alias("bins"))


def regression(df: DataFrame, y: str, guess: str, keys: Sequence[str] = ()) -> DataFrame:
    e = F.col(y) - F.col(guess)
    agg = df.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.abs(F.col(y)) > 1e-9, F.abs(e / F.col(y)))).alias("mape"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"), F.count(y).alias("n")
    )
    r = lambda c, n: F.round(c, 6).alias(n)
    return agg.select(*keys, r(F.col("mae"), "mae"), r(F.col("rmse"), "rmse"), r(F.col("mape"), "mape"), r(F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")), "r2"), "n")


def at_k(df: DataFrame, truth: Column, score: str, i: str, k: int, threshold: float) -> DataFrame:
    """Precision and recall of the k highest scores, and the false-positive rate at a threshold."""
    top = df.orderBy(F.desc(score), i).limit(k).agg(F.count_if(truth).alias("found"))
    every = df.agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("q"), F.count_if(~truth & (F.col(score) >= threshold)).alias("fp"))
    return top.crossJoin(every).select(F.round(F.col("found") / k, 6).alias("precision"), F.round(_ratio(F.col("found"), F.col("p")), 6).alias("recall"), F.round(_ratio(F.col("fp"), F.col("q")), 6).alias("fpr"))


def rank_stability(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two scores, ties at their average rank, from counts per value."""

    def average(c: str) -> DataFrame:
        n = running(df.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [F.col(c)], ["n"])
        return n.select(F.col(c).alias(f"{c}_key"), (F.col("n_before") + (F.col("n") + 1) / 2.0).alias(f"{c}_rank"))

    both = df.join(average(a), F.col(a) == F.col(f"{a}_key")).join(average(b), F.col(b) == F.col(f"{b}_key"))
    return both.agg(F.round(F.corr(f"{a}_rank", f"{b}_rank"), 6).alias("rho"))
