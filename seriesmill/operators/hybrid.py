"""Evidence for typed questions by five scores at once: words, character grams, the measure asked for, time and what is abnormal.

A question meets the rows of its own patient alone. Questions and rows are dealt by patient, and what a score needs is brought to them before
they meet; so all scores are columns of the pairs, and windows over a question's pairs stay where the pairs were made: pairs are
neither shuffled nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from .retrieval import SCORES, gram_tfidf

#: Pairs of a task, and of a patient beyond which the patient's questions are dealt to several.
PAIRS = 1 << 20
#: What the pairs of one question have in common; windows over all three need no shuffle, as the pairs are dealt by the first two.
_QUESTION = ["patient_id", "share_", "query_id"]
_DATED = ("EXACT_DATE", "BETWEEN", "BEFORE", "AFTER", "SINCE")


def evidence_text(columns: list[str]) -> Column:
    """A row's words: measure, value, unit, flag (which also says abnormal) and its day, year and month."""
    day = F.date_format("ts", "yyyy-MM-dd")
    extra = [F.col("unit")] if "unit" in columns else []
    if "flag" in columns:
        extra += [F.col("flag"), F.when(F.lower("flag").isin("abnormal", "high", "low"), "abnormal out of range")]
    return F.concat_ws(" ", F.col("analyte"), F.col("value").cast("string"), *extra, day, F.substring(day, 1, 4), F.substring(day, 6, 2))


def _dealt(questions: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by patient over tasks of about ``PAIRS`` pairs. The rows of a patient with more are copied to several, each with
    a share of the questions."""
    count = lambda df, n: df.groupBy("patient_id").agg(F.count(F.lit(1)).alias(n))
    sizes = count(observations, "rows").join(count(questions, "asked"), "patient_id").select("patient_id", F.ceil(F.col("rows") * F.col("asked") / PAIRS).alias("shares"), (F.col("rows") * F.col("asked")).alias("pairs"))
    many = sizes.filter("shares > 1").select("patient_id", "shares")
    every, hot = sizes.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count_if(F.col("shares") > 1)).first()
    tasks = max(int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every // PAIRS))
    if hot:
        # no more patients than there are tasks
        shares = F.coalesce("shares", F.lit(1))
        questions = questions.join(F.broadcast(many), "patient_id", "left").withColumn("share_", F.pmod(F.xxhash64("query_id"), shares)).drop("shares")
        observations = observations.join(F.broadcast(many), "patient_id", "left").withColumn("share_", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("shares")
        return questions.repartition(tasks, "patient_id", "share_"), observations.repartition(tasks, "patient_id", "share_")
    return questions.repartition(tasks, "patient_id"), observations.repartition(tasks, "patient_id")


def pairs_of(questions: DataFrame, observations: DataFrame, abnormal: Column) -> DataFrame:
    """Each question (``selection.QUESTION``) with each row of its patient: asked is the question's measure, own says whether a row is
    of the series that the question is about: rows of that measure or whose name holds it, or all rows where none is."""
    asked, rows = _dealt(questions.withColumnRenamed("analyte", "asked"), observations.withColumn("bad", F.coalesce(abnormal, F.lit(False))))
    keys = [k for k in _QUESTION[:2] if k in asked.columns]
    pairs = rows.join(asked, keys)
    if len(keys) == 1:
        pairs = pairs.withColumn("share_", F.lit(0).cast("long"))
    low, want = F.lower("analyte"), F.lower(F.trim("asked"))
    match = F.coalesce((low == want) | F.contains(low, want) & (want != ""), F.lit(False))
    pairs = pairs.withColumn("match", match)
    return pairs.withColumn("own", F.col("match") | ~F.max("match").over(Window.partitionBy(_QUESTION)))


def concept(pairs: DataFrame) -> Column:
    """1 by the same code (where both have one), 0.95 by name, 0.75 by a name that holds it, 0.5 where nothing is asked, else 0."""
    low, want = F.lower(F.trim("analyte")), F.lower(F.trim("asked"))
    score = F.when(F.col("asked").isNull(), 0.5)
    if {"code", "asked_code"} <= set(pairs.columns):
        score = score.when(F.col("code") == F.col("asked_code"), 1.0)
    return score.when(low == want, 0.95).when(F.contains(low, want) & (want != ""), 0.75).otherwise(0.0)


def temporal() -> Column:
    """How well a row's time fits its question, by intent and operator; ranks are those within the question's own series."""
    said = lambda c: F.upper(F.coalesce(c, F.lit("")))
    intent, op, own = said("intent"), said("operator"), F.col("own")
    of_series = Window.partitionBy(*_QUESTION, "own")
    back = F.row_number().over(of_series.orderBy(F.desc("ts"), F.desc("evidence_id"))) - 1
    n, day, start, end = F.count(F.lit(1)).over(of_series), F.to_date("ts"), F.to_date("start_ts"), F.to_date("end_ts")
    series_only = lambda score: F.when(own, score).otherwise(0.0)
    yes = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    compares = intent.contains("COMPARISON")
    before = compares & ((said("against") == "PREVIOUS") | F.contains(F.lower(F.coalesce("raw_query", F.lit(""))), F.lit("previous"))) | intent.contains("PREVIOUS")
    both = start.isNotNull() & end.isNotNull()
    bounded = start.isNotNull() | end.isNotNull() | ~op.isin("", "NONE", "ALL_TIME")
    within = (
        F.when((op == "EXACT_DATE") & start.isNotNull() | both & (start == end), yes(day == start)).when(both, yes(day.between(start, end)))
        .when(start.isNotNull(), yes(day >= start)).when(end.isNotNull(), yes(day <= end)).otherwise(0.5)
    )
    return (
        F.when(intent.contains("CURRENT") | (op == "LATEST"), series_only(1.0 / (1.0 + 2.0 * back)))
        .when(intent.contains("LAST_N") | (op == "LAST_N"), series_only(F.when(back < F.coalesce("wanted", F.lit(3)), F.greatest(F.lit(0.8), 1.0 - 0.05 * back)).otherwise(0.1)))
        .when(before, series_only(F.when((back == 1) | (n == 1), 1.0).when(back == 0, 0.5).otherwise(0.0))).when(compares & both, yes((day == start) | (day == end)))
        .when(intent.contains("TREND") | intent.contains("HISTORICAL") & (op == "ALL_TIME"), yes(own)).when(bounded, within).otherwise(0.5)
    )


def intent() -> Column:
    """1 for every row unless abnormal ones are asked for; then 1 for those and 0 for others, and where the first is asked for, 1 for
    the earliest of the measure and 0.5 for the other abnormal ones."""
    raw = F.lower(F.coalesce("raw_query", F.lit("")))
    asks = F.coalesce("abnormal_only", F.lit(False)) | F.upper(F.coalesce("intent", F.lit(""))).contains("ABNORMALITY") | F.contains(raw, F.lit("abnormal"))
    meant = F.col("bad") & (F.col("match") | F.col("asked").isNull() | (F.trim("asked") == ""))
    first = F.min_by("evidence_id", F.when(meant, F.struct("ts", "evidence_id"))).over(Window.partitionBy(_QUESTION))
    plain = F.when(F.col("bad"), 1.0).otherwise(0.0)
    return F.when(~asks, 1.0).when(F.contains(raw, F.lit("first")) & first.isNotNull(), F.when(F.col("evidence_id") == first, 1.0).when(F.col("bad"), 0.5).otherwise(0.0)).otherwise(plain)


def _with_words(questions: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with words_ (its words that the patient's rows hold: word, weight by count and idf among those rows) and usual_ (the rows' mean
    number of words); rows with held_, their words."""
    rows = observations.withColumn("held_", F.coalesce(scalar.tokenize(evidence_text(observations.columns)), F.array().cast("array<string>")))
    said = questions.select("patient_id", "query_id", F.explode(scalar.tokenize(F.col("raw_query"))).alias("word")).groupBy("patient_id", "query_id", "word").agg(F.count(F.lit(1)).alias("times"))
    per = rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.size("held_")).alias("usual_"))
    asked = said.groupBy("patient_id").agg(F.collect_set("word").alias("asked_"))
    found = rows.join(asked, "patient_id").select("patient_id", F.explode(F.array_intersect("held_", "asked_")).alias("word")).groupBy("patient_id", "word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = said.join(found.join(per, "patient_id"), ["patient_id", "word"]).groupBy("query_id", "patient_id", "usual_").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("times") * idf).alias("weight")))).alias("words_"))
    return questions.join(weighed, ["query_id", "patient_id"], "left"), rows


def lexical(k1: float = 1.5, b: float = 0.75) -> Column:
    """BM25 among the patient's own rows; null without a common word."""
    times = F.transform("words_", lambda x: F.struct(x["weight"].alias("weight"), F.size(F.filter("held_", lambda w: w == x["word"])).alias("tf")))
    hits = F.filter(times, lambda x: x["tf"] > 0)
    part = lambda x: x["weight"] * x["tf"] * (k1 + 1) / (x["tf"] + k1 * (1 - b + b * F.size("held_") / F.col("usual_")))
    return F.nullif(F.round(F.aggregate(hits, F.lit(0.0), lambda s, x: s + part(x)), 6), F.lit(0.0))


def _with_grams(questions: DataFrame, observations: DataFrame) -> DataFrame:
    """Questions with alike_: the cosine of the character grams of the question and of each of the patient's measures. Both are few distinct
    texts beside the pairs."""
    asked = questions.select("patient_id", F.col("raw_query").alias("q")).filter("q is not null").distinct()
    near = asked.join(observations.select("patient_id", F.col("analyte").alias("a")).filter("a is not null").distinct(), "patient_id")
    met = near.select("q", "a").distinct()
    texts = met.select(F.col("q").alias("text")).union(met.select(F.col("a").alias("text"))).distinct().withColumn("t", F.col("text"))
    grams = gram_tfidf(texts, ["t"])
    left, right = grams.select(F.col("t").alias("q"), "gram", F.col("weight").alias("qw")), grams.select(F.col("t").alias("a"), "gram", F.col("weight").alias("aw"))
    cosine = met.join(left, "q").join(right, ["a", "gram"]).groupBy("q", "a").agg(F.round(F.sum(F.col("qw") * F.col("aw")), 6).alias("semantic"))
    alike = near.join(cosine, ["q", "a"]).groupBy("patient_id", "q").agg(F.map_from_entries(F.collect_list(F.struct("a", "semantic"))).alias("alike_"))
    return questions.join(alike.withColumnRenamed("q", "raw_query"), ["patient_id", "raw_query"], "left")


def retrieve_evidence(
    questions: DataFrame, observations: DataFrame, weights: dict[str, float], k: int = 10, abnormal: Column | None = None, by_rank: bool = False, gate: bool = True, rank_k: int = 60
) -> DataFrame:
    """questions (``selection.QUESTION``) and observations (patient_id, analyte, ts, value, evidence_id and perhaps unit, flag, code) ->
    query_id, evidence_id, score, rank and the five scores. ``weights`` by name of ``retrieval.SCORES``; scores without weight aren't
    computed and are null. ``by_rank``: words and grams go in by their ranks, with the weight that the others leave. ``gate``: where
    a question names dates and some row fits them, rows that don't score 0. Ties go to the newer row, then to the lesser id."""
    use = {name for name in SCORES if weights.get(name)} | ({"lexical", "semantic"} if by_rank else set())
    if "lexical" in use:
        questions, observations = _with_words(questions, observations)
    if "semantic" in use:
        questions = _with_grams(questions, observations)
    rows = pairs_of(questions, observations, F.lit(False) if abnormal is None else abnormal)
    if "lexical" in use:
        rows = rows.withColumn("raw_lexical", lexical()).withColumn("lexical", F.coalesce(scalar.max_scale("raw_lexical", _QUESTION), F.lit(0.0)))
    if "semantic" in use:
        rows = rows.withColumn("semantic", F.coalesce(F.col("alike_")[F.col("analyte")], F.lit(0.0)))
    dated = F.col("start_ts").isNotNull() | F.col("end_ts").isNotNull() | F.upper(F.coalesce("operator", F.lit(""))).isin(*_DATED)
    rows = rows.withColumns({name: F.round(make, 6) for name, make in (("concept", concept(rows)), ("temporal", temporal()), ("intent", intent())) if name in use or name == "temporal" and gate})
    w, weigh = Window.partitionBy(_QUESTION), lambda names: sum((F.col(n) * float(weights[n]) for n in names if weights.get(n)), F.lit(0.0))
    if by_rank:
        n = F.count(F.lit(1)).over(w)
        place = lambda c: F.when(F.col(c) > 0, F.row_number().over(w.orderBy(F.desc(c), F.desc("ts"), "evidence_id"))).otherwise(n)
        rows = rows.withColumn("base_", 1.0 / (rank_k + place("lexical")) + 1.0 / (rank_k + place("semantic")))
        rest = max(0.0, 1.0 - sum(float(weights.get(n, 0.0)) for n in ("concept", "temporal", "intent")))
        score = scalar.max_scale("base_", _QUESTION) * rest + weigh(("concept", "temporal", "intent"))
    else:
        score = weigh(SCORES)
    rows = rows.withColumn("score", score)
    if gate:
        shut = dated & (F.max("temporal").over(w) > 0) & (F.col("temporal") == 0)
        rows = rows.withColumn("score", F.when(shut, 0.0).otherwise(F.col("score")))
    rows = rows.withColumn("score", F.round("score", 6))
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), F.desc("ts"), "evidence_id"))).filter(F.col("rank") <= k)
    shown = [F.col(name) if name in use else F.lit(None).cast("double").alias(name) for name in SCORES]
    return rows.select("query_id", "evidence_id", "score", "rank", *shown)
