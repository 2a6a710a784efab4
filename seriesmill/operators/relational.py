"""Filters, joins, set operations and top-k of the engine. Lookups are joined plainly: Spark broadcasts them by their
size, and shuffles where they have grown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters and predicates ---
def scope_filter(df: DataFrame, owner, column: str = "patient_id") -> DataFrame:
    """The owner's rows. None is refused; an empty id has no rows."""
    if owner is None:
        raise ValueError("an owner is required")
    return df.filter(F.lit(False)) if owner == "" else df.filter(F.col(column) == F.lit(owner))


def scope_predicate(patient: Column, owner: Column, p, o) -> Column:
    """The patient's own rows, or the owner's that belong to no patient."""
    return (patient == F.lit(p)) | (patient.isNull() & (owner == F.lit(o)))


def date_window(df: DataFrame, t: str, op: str, start: str, end: str | None = None) -> DataFrame:
    """EXACT, BETWEEN, BEFORE, AFTER, SINCE on the date; undated rows are out. Bounds are put on the column itself, so
    that they reach the scan."""
    a = F.lit(start).cast("date")
    b = F.lit(end).cast("date") if end else a
    c = F.col(t)
    test = {
        "EXACT": (c >= a) & (c < F.date_add(a, 1)), "BETWEEN": (c >= a) & (c < F.date_add(b, 1)), "BEFORE": c < a, "AFTER": c >= F.date_add(a, 1), "SINCE": c >= a,
    }[op]
    return df.filter(test)


def relative_window(df: DataFrame, t: str, anchor: str, n: int, unit: str) -> DataFrame:
    """The last n days, weeks, months or years up to the anchor; months end on their last day where the day is missing."""
    a = F.lit(anchor).cast("date")
    start = {"day": F.date_sub(a, n), "week": F.date_sub(a, 7 * n), "month": F.add_months(a, -n), "year": F.add_months(a, -12 * n)}[unit]
    return df.filter((F.col(t) >= start) & (F.col(t) < F.date_add(a, 1)))


def abnormal_cohort(df: DataFrame, limits: DataFrame, v: str = "value", k: str = "analyte") -> DataFrame:
    """abnormal by a flag word, else by the row's own reference range, else by the analyte's limits, each of which is
    inclusive or not."""
    x = F.col(v)
    flag = F.lower(F.trim("flag")).isin("h", "l", "high", "low", "abnormal", "critical")
    own = F.when(F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull(), (x < F.coalesce("ref_low", F.lit(float("-inf")))) | (x > F.coalesce("ref_high", F.lit(float("inf")))))
    low = F.when(F.col("low_inclusive"), x <= F.col("low")).otherwise(x < F.col("low"))
    high = F.when(F.col("high_inclusive"), x >= F.col("high")).otherwise(x > F.col("high"))
    test = F.when(F.coalesce(flag, F.lit(False)), True).when(F.coalesce(own, F.lit(False)), True).otherwise(F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False)))
    return df.join(limits, k, "left").select(*df.columns, test.alias("abnormal"))


def abnormal_strict(df: DataFrame, limits: DataFrame, v: str = "value", k: str = "analyte") -> DataFrame:
    """abnormal by precedence: an explicit flag decides either way, then a reference range, then the limits, upper one
    inclusive."""
    x, word = F.col(v), F.lower(F.trim("flag"))
    ranged = F.col("ref_low").isNotNull() & F.col("ref_high").isNotNull()
    test = (
        F.when(word.isin("n", "normal"), False).when(word.isin("h", "l", "high", "low", "abnormal", "critical"), True)
        .when(ranged, ~x.between(F.col("ref_low"), F.col("ref_high"))).otherwise(F.coalesce(x < F.col("low"), F.lit(False)) | F.coalesce(x >= F.col("high"), F.lit(False)))
    )
    return df.join(limits, k, "left").select(*df.columns, test.alias("abnormal"))


def range_status(v: Column, low: Column, high: Column) -> Column:
    return F.when(v.isNull() | (low.isNull() & high.isNull()), "unknown").when(v < low, "low").when(v > high, "high").otherwise("normal")


def hard_gate(scored: DataFrame, query: str, inside: str, explicit: str, score: str = "score") -> DataFrame:
    """Score 0 for rows outside an explicit date window, where some row of the query is inside."""
    some = F.max(F.col(inside).cast("int")).over(Window.partitionBy(query)) == 1
    return scored.withColumn(score, F.when(F.col(explicit) & some & ~F.col(inside), 0.0).otherwise(F.col(score)))


def eligible(scored: DataFrame, patient: str, query_patient: str, score: str = "score") -> DataFrame:
    return scored.filter((F.col(patient) == F.col(query_patient)) & (F.col(score) > 0))


def clean_date(s: Column) -> Column:
    """ISO text to a date; anything else is null."""
    return F.when(F.trim(s).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(F.trim(s), 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def real_files(df: DataFrame, path: str, prefix: str = "demo://") -> DataFrame:
    return df.filter(~F.col(path).startswith(prefix))


def fill_date(values: DataFrame, docs: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """The row's own date, else its document's."""
    return values.join(docs.select(key, other), key, "left").withColumn(own, F.coalesce(own, other)).drop(other)


def search_rows(df: DataFrame, text: str, newest: str) -> DataFrame:
    """Rows with the text anywhere in their fields, whatever the case; newest first."""
    return df.filter(F.contains(F.lower(F.to_json(F.struct(*df.columns))), F.lit(text.lower()))).orderBy(F.desc(newest))


def filter_then_topk(df: DataFrame, where: dict[str, str], query: str, order: Sequence[Column], k: int) -> DataFrame:
    """Case-insensitive equality on metadata first, then the top k of each query."""
    for name, value in where.items():
        df = df.filter(F.lower(F.col(name).cast("string")) == value.lower())
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).filter(F.col("rank") <= k)


def quality_gate(df: DataFrame, rules: Sequence[tuple[str, Column, float]], ready: float = 60.0) -> DataFrame:
    """Rules (problem, test, penalty) -> score from 100 down, problems, ready."""
    lost = sum((F.when(test, penalty).otherwise(0.0) for _, test, penalty in rules), F.lit(0.0))
    problems = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test, _ in rules)))
    score = F.greatest(F.lit(0.0), 100.0 - lost)
    return df.withColumns({"score": score, "problems": problems, "ready": score >= ready})


# --- joins ---
def dictionary_join(events: DataFrame, items: DataFrame, key: str, label: str) -> DataFrame:
    """Items' columns onto events; a missing label becomes ITEM_<key>."""
    return events.join(items, key, "left").withColumn(label, F.coalesce(label, F.concat(F.lit("ITEM_"), F.col(key).cast("string"))))


def map_terms(df: DataFrame, codes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical name by code, else by alias, else unmapped; lookups have one row per code and alias."""
    by_code = codes.select("code", F.col("canonical").alias("c1"))
    by_alias = aliases.select("alias", F.col("canonical").alias("c2"))
    out = df.join(by_code, "code", "left").join(by_alias, F.lower(F.trim("name")) == F.col("alias"), "left")
    status = F.when(F.col("c1").isNotNull(), "code").when(F.col("c2").isNotNull(), "alias").otherwise("unmapped")
    return out.select(*df.columns, F.coalesce("c1", "c2").alias("canonical"), status.alias("mapping_status"))


def assign_split(df: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    return df.join(splits, key, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def scoped_semi(events: DataFrame, reports: DataFrame, key: str, other: str) -> DataFrame:
    return events.join(reports, F.col(key) == F.col(other), "left_semi")


def missing_candidates(gold: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    return gold.join(corpus.select(key), key, "left_anti")


def result_outcome(gold: DataFrame, ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """hit, miss or extra for each pair of either side."""
    g, r = gold.select(*keys, F.lit(True).alias("g")), ranked.select(*keys, F.lit(True).alias("r"))
    both = g.join(r, list(keys), "full_outer")
    return both.select(*keys, F.when(F.col("g") & F.col("r"), "hit").when(F.col("g"), "miss").otherwise("extra").alias("outcome"))


def query_pairs(queries: DataFrame, obs: DataFrame, key: str = "patient_id") -> DataFrame:
    """Each query with its own patient's rows only."""
    return queries.join(obs, key)


def window_join(queries: DataFrame, obs: DataFrame, keys: Sequence[str], t: str, start: str, end: str) -> DataFrame:
    """Rows of the query's patient between its dates, inclusive: equality keys carry the join, the range is its residue."""
    q = queries.select("query_id", start, end, *(F.col(k).alias(f"q_{k}") for k in keys))
    same = [F.col(f"q_{k}") == F.col(k) for k in keys]
    return q.join(obs, [*same, F.col(t) >= F.col(start), F.col(t) < F.date_add(F.col(end), 1)]).drop(*(f"q_{k}" for k in keys))


def nearest(anchors: DataFrame, obs: DataFrame, keys: Sequence[str], at: str, t: str, i: str) -> DataFrame:
    """As-of join, both directions: for each anchor its key's row with the least gap in time; ties to the earlier row,
    then the lesser id. One pass over the union in order of time finds the last row before and the first from there on, so
    nothing is paired that isn't a candidate."""
    rest = [c for c in obs.columns if c not in keys]
    a = anchors.select(*keys, F.col(at).alias("at_"), F.lit(1).alias("anchor_"), F.lit(None).cast(obs.select(F.struct(*rest).alias("r")).schema["r"].dataType).alias("row_"), F.struct(*anchors.columns).alias("own_"))
    o = obs.select(*keys, F.col(t).alias("at_"), F.lit(0).alias("anchor_"), F.struct(*rest).alias("row_"), F.lit(None).cast(a.schema["own_"].dataType).alias("own_"))
    # of rows at one time only the least id can win, so the walk down in time sees it last before the anchor
    down = Window.partitionBy(*keys).orderBy("at_", "anchor_", F.desc(f"row_.{i}")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*keys).orderBy(F.desc("at_"), "anchor_", F.desc(f"row_.{i}")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(o).withColumns({"b": F.last("row_", ignorenulls=True).over(down), "f": F.last("row_", ignorenulls=True).over(up)}).filter("anchor_ = 1")
    gap = lambda r: F.abs(F.unix_micros(F.col("at_").cast("timestamp")) - F.unix_micros(F.col(f"{r}.{t}").cast("timestamp")))
    pick = F.when(F.col("b").isNull(), F.col("f")).when(F.col("f").isNull() | (gap("b") <= gap("f")), F.col("b")).otherwise(F.col("f"))
    return both.withColumn("pick", pick).filter("pick is not null").select("own_.*", *(F.col(f"pick.{c}").alias(c) for c in rest))


# --- sets, sorting and top-k ---
def split_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split; none is right."""
    return df.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def merge_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def selection_union(primary: DataFrame, supporting: DataFrame, key: str) -> DataFrame:
    """Union by id; primary rows win."""
    both = primary.withColumn("src", F.lit(0)).unionByName(supporting.withColumn("src", F.lit(1)))
    rest = [c for c in primary.columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "src").alias("r"), F.min("src").alias("src")).select(key, "r.*", (F.col("src") == 0).alias("is_primary"))


def fabricated_ids(claims: DataFrame, package: DataFrame, cited: str, known: str, on: str) -> DataFrame:
    return claims.join(package, on).select(on, F.array_except(cited, known).alias("fabricated")).filter(F.size("fabricated") > 0)


def rank_results(df: DataFrame, query: str, k: int, score: str = "score", t: str = "ts", i: str = "evidence_id") -> DataFrame:
    """Ranks 1 to k by score (6 places), then newest, then id."""
    w = Window.partitionBy(query).orderBy(F.desc(F.round(score, 6)), F.col(t).desc_nulls_last(), i)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def topk_positive(df: DataFrame, query: str, k: int, score: str, i: str) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc(score), i)
    return df.filter(F.col(score) > 0).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_unique_label(df: DataFrame, query: str, label: str, k: int, score: str) -> DataFrame:
    best = df.groupBy(query, label).agg(F.max(score).alias(score))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), label))).filter(F.col("rank") <= k)


def merge_topk(a: DataFrame, b: DataFrame, query: str, k: int, score: str, i: str) -> DataFrame:
    return topk_positive(merge_sources(a, b), query, k, score, i)


def top_errors(df: DataFrame, true: str, predicted: str, n: int) -> DataFrame:
    return df.filter(F.col(true) != F.col(predicted)).groupBy(true, predicted).count().orderBy(F.desc("count"), true, predicted).limit(n)
