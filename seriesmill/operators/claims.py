"""From selected evidence to facts, from facts to sentences with their sources, and from sentences back to the facts they must stand on.

``selected`` is the table of ``selection.select_evidence`` (query_id, mode, evidence_id, ts, value, role, is_primary), with a flag
column or without. Facts of a question are aggregates of its rows, never a list of them, so a question about a
long series costs no more than its rows; only the question for its last n rows lists them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import kept


def _row() -> Column:
    return F.struct(F.col("evidence_id").alias("id"), "ts", "value", "flag")


def sheet(selected: DataFrame) -> DataFrame:
    """One row for each question: mode, n, its first and last row, those with a value (v_first, v_last), the least and the greatest
    (first of equal ones), the row before the latest and the latest as reference, the first abnormal row, the turning
    point, the rows of a question for the last n; and from them span (days), delta, direction, and how far the turning point lies from
    the straight line between v_first and v_last."""
    rows = selected if "flag" in selected.columns else selected.withColumn("flag", F.lit(None).cast("string"))
    at, has = F.struct("ts", "evidence_id"), F.col("value").isNotNull()
    valued, role = F.when(has, _row()), lambda *names: F.when(F.col("role").isin(*names), _row())
    first = lambda row, order=at: F.min_by(row, F.when(row.isNotNull(), order))
    low, high = F.when(has, F.struct("value", "ts", "evidence_id")), F.when(has, F.struct((-F.col("value")).alias("less"), "ts", "evidence_id"))
    per = rows.groupBy("query_id", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(_row(), at).alias("first"), F.max_by(_row(), at).alias("last"), first(valued).alias("v_first"), F.max_by(valued, F.when(has, at)).alias("v_last"),
        F.min_by(valued, low).alias("least"), F.min_by(valued, high).alias("greatest"), first(role("predecessor", "only_observation_available")).alias("before"), first(role("reference_latest")).alias("latest"),
        first(role("first_abnormal", "abnormal")).alias("bad"), first(role("inflection_point")).alias("turn"), F.array_sort(F.collect_list(F.when(F.col("mode") == "last_n", F.struct("ts", "evidence_id", "value")))).alias("listed"),
    )
    seconds = lambda r: F.unix_micros(F.col(f"{r}.ts").cast("timestamp")) / 1e6
    span = F.round(F.greatest((seconds("v_last") - seconds("v_first")) / 86400, F.lit(0.0)), 2)
    delta = F.round(F.col("v_last.value") - F.col("v_first.value"), 4)
    direction = F.when(F.col("delta") > 1e-4, "increased").when(F.col("delta") < -1e-4, "decreased").when(F.col("delta").isNotNull(), "stable")
    share = (seconds("turn") - seconds("v_first")) / F.nullif(seconds("v_last") - seconds("v_first"), F.lit(0.0))
    off = F.round(F.abs(F.col("turn.value") - F.col("v_first.value") - share * (F.col("v_last.value") - F.col("v_first.value"))), 4)
    return per.withColumns({"span": span, "delta": delta}).withColumns({"direction": direction, "off": off})


def derived_facts(selected: DataFrame) -> DataFrame:
    """query_id, fact, value, word, contributors, start_ts, end_ts: span_days, absolute_delta, relative_change_pct (unless the
    first value is 0), direction (its word), slope_per_day (unless the span is 0), min_value, max_value, inflection_point. A question
    without any value has none."""
    s = sheet(selected).filter("v_first is not null")
    ends = F.array_distinct(F.array("v_first.id", "v_last.id"))

    def fact(name: str, value: Column, ids: Column = ends, start: str = "v_first", end: str = "v_last", word: Column | None = None, when: Column | None = None) -> Column:
        made = F.struct(
            F.lit(name).alias("fact"), value.cast("double").alias("value"), (F.lit(None).cast("string") if word is None else word).alias("word"), ids.alias("contributors"),
            F.col(f"{start}.ts").alias("start_ts"), F.col(f"{end}.ts").alias("end_ts"),
        )
        return made if when is None else F.when(when, made)

    base = F.abs("v_first.value")
    facts = F.array(
        fact("span_days", F.col("span")), fact("absolute_delta", F.col("delta")), fact("relative_change_pct", F.round(F.col("delta") / F.nullif(base, F.lit(0.0)) * 100, 2), when=base > 1e-6),
        fact("direction", F.lit(None), word=F.col("direction")), fact("slope_per_day", F.round(F.col("delta") / F.nullif("span", F.lit(0.0)), 6), when=F.col("span") > 0),
        fact("min_value", F.col("least.value"), F.array("least.id"), "least", "least"), fact("max_value", F.col("greatest.value"), F.array("greatest.id"), "greatest", "greatest"),
        fact("inflection_point", F.col("off"), F.array("v_first.id", "turn.id", "v_last.id"), "turn", "turn", when=F.col("turn.value").isNotNull()),
    )
    return s.select("query_id", F.inline(F.filter(facts, lambda f: f.isNotNull())))


# --- sentences ---
#: Forms of sentences by mode: (modes, place, kind, form, rows cited, numbers, rows whose dates are named, condition). In a form
#: {measure} is the question's, {n} the number of rows, {row.value}, {row.date} and {row.id} a row's, {list} all rows of
#: the last n, {by} the size of the change, {days} whole days. Questions of one row are told as the current value.
_MANY = ("dates", "trend")
_FORMS = (
    (("previous",), 1, "observed", "Before the latest test, {measure} was {before.value} on {before.date} [{before.id}].", ("before",), ("before.value",), ("before",), "before is not null"),
    (("previous",), 2, "observed", "The latest {measure} is {latest.value}, of {latest.date} [{latest.id}].", ("latest",), ("latest.value",), ("latest",), "before is not null and latest is not null"),
    (("previous",), 3, "derived", "Between the two, {measure} {direction} by {by} [{before.id}, {latest.id}].", ("before", "latest"), ("by",), (), "before is not null and latest is not null and delta is not null"),
    (("current", "fallback"), 1, "observed", "The latest {measure} is {last.value}, measured on {last.date} [{last.id}].", ("last",), ("last.value",), ("last",), "true"),
    (("current", "fallback"), 2, "observed", "It was flagged as {last.flag} [{last.id}].", ("last",), (), (), "last.flag is not null and lower(last.flag) not in ('normal', '')"),
    (("last_n",), 1, "observed", "The last {n} values of {measure}: {list}.", ("list",), ("list",), ("list",), "true"),
    (("last_n",), 2, "derived", "Over these {n} values, {measure} {direction} by {by} [{first.id}, {last.id}].", ("first", "last"), ("by",), (), "n > 1 and delta is not null"),
    (("first_abnormal", "abnormal"), 1, "observed", "The first abnormal {measure} on record is {bad.value}, of {bad.date} [{bad.id}].", ("bad",), ("bad.value",), ("bad",), "bad is not null"),
    (("first_abnormal", "abnormal"), 1, "observed", "No abnormal {measure} was found; the latest is {last.value}, of {last.date} [{last.id}].", ("last",), ("last.value",), ("last",), "bad is null"),
    (("dates",), 1, "observed", "{measure} was {first.value} on {first.date} [{first.id}] and {last.value} on {last.date} [{last.id}].", ("first", "last"), ("first.value", "last.value"), ("first", "last"), "true"),
    (("dates",), 2, "derived", "It {direction} by {by} over {days} days [{first.id}, {last.id}].", ("first", "last"), ("by",), (), "delta is not null"),
    (("interval",), 1, "observed", "From {first.date} to {last.date}, {n} values of {measure} were recorded [{first.id}, {last.id}].", ("first", "last"), (), ("first", "last"), "true"),
    (("interval",), 2, "derived", "{measure} {direction} from {first.value} to {last.value} [{first.id}, {last.id}].", ("first", "last"), ("first.value", "last.value"), (), "n > 1 and delta is not null"),
    (("trend",), 1, "observed", "{measure} went from {first.value} on {first.date} [{first.id}] to {last.value} on {last.date} [{last.id}].", ("first", "last"), ("first.value", "last.value"), ("first", "last"), "true"),
    (("trend",), 2, "derived", "It turned at {turn.value} on {turn.date} [{turn.id}].", ("turn",), ("turn.value",), ("turn",), "turn.value is not null"),
    (("trend",), 3, "derived", "Overall, {measure} {direction} by {by} over {days} days [{first.id}, {last.id}].", ("first", "last"), ("by",), (), "delta is not null"),
)


def shown(x: Column) -> Column:
    """A number with at most four decimals and none that say nothing."""
    return F.when(x.isNotNull(), F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"\.?0+$", "")).otherwise("unknown")


def _day(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def claims(selected: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, place, kind, sentence, cited, numbers, dates: what can be said to each question, by its mode, with the ids it stands
    on and the numbers and dates it names. ``questions`` gives the measure (query_id, analyte)."""
    s = sheet(selected).join(questions.select("query_id", F.col("analyte").alias("measure")), "query_id")
    mode = F.when(F.col("mode").isin(*_MANY) & (F.col("n") == 1), "fallback").otherwise(F.col("mode"))

    def word(token: str) -> Column:
        row, _, part = token.partition(".")
        if part:
            field = F.col(f"{row}.{part if part != 'date' else 'ts'}")
            return shown(field) if part == "value" else _day(field) if part == "date" else field.cast("string")
        listed = F.array_join(F.transform("listed", lambda r: F.concat(shown(r["value"]), F.lit(" on "), _day(r["ts"]), F.lit(" ["), r["evidence_id"].cast("string"), F.lit("]"))), ", ")
        return {"measure": F.col("measure"), "n": F.col("n").cast("string"), "direction": F.col("direction"), "by": shown(F.abs("delta")), "days": F.floor("span").cast("string"), "list": listed}[token]

    def spread(names: tuple, of_row, of_list, empty: str) -> Column:
        if names == ("list",):
            return of_list
        return F.array(*(of_row(x) for x in names)) if names else F.array().cast(empty)

    kind = dict(selected.dtypes)["evidence_id"]
    made = []
    for modes, place, fact, form, cited, numbers, dates, condition in _FORMS:
        parts = [word(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{[a-z_.]+\})", form) if p]
        made.append(F.when(
            F.col("told").isin(*modes) & F.expr(condition),
            F.struct(
                F.lit(place).alias("place"), F.lit(fact).alias("kind"), F.concat(*parts).alias("sentence"), spread(cited, lambda x: F.col(f"{x}.id"), F.transform("listed", lambda r: r["evidence_id"]), f"array<{kind}>").alias("cited"),
                F.array_compact(spread(numbers, lambda x: F.abs("delta") if x == "by" else F.col(x), F.transform("listed", lambda r: r["value"]), "array<double>")).cast("array<double>").alias("numbers"),
                spread(dates, lambda x: _day(F.col(f"{x}.ts")), F.transform("listed", lambda r: _day(r["ts"])), "array<string>").alias("dates"),
            ),
        ))
    return s.withColumn("told", mode).select("query_id", F.inline(F.filter(F.array(*made), lambda c: c.isNotNull())))


# --- verification ---
#: Small numbers that count or order and prove nothing: fixed values.
IGNORED = (1.0, 2.0, 3.0, 4.0, 5.0, 10.0, 14.0)
_NUMBER, _DATE = r"(?<![\w.])[-+]?\d+(?:\.\d+)?(?![\w]|\.\d)", r"\b(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})\b"


def verify_claims(told: DataFrame, selected: DataFrame, facts: DataFrame, within: float = 0.01) -> DataFrame:
    """told (query_id, place, sentence, cited, and perhaps numbers and dates) against the selected rows and derived facts of its
    question -> told's rows with grounded and reasons.

    A claim must cite something, and only selected rows. Each number must lie within ``within`` of a cited row's value, or of a
    fact whose contributors are among the cited rows or the other way round (also rounded to one or two decimals), the sign
    left aside; each date must be that of a cited row, year first or day first. Where a claim's list of numbers or dates
    is null, they are read from its sentence, without the dates and what stands in brackets. Reasons are sorted; a claim with none is
    grounded."""
    # read three times below, so sheets and sentences are made once
    told = kept(told, "told")
    plain = F.regexp_replace("sentence", r"\[[^\]]*\]", " ")
    said = lambda name, read: F.coalesce(name, read) if name in told.columns else read
    dates = said("dates", F.regexp_extract_all(plain, F.lit(_DATE), F.lit(0)))
    numbers = said("numbers", F.transform(F.regexp_extract_all(F.regexp_replace(plain, _DATE, " "), F.lit(_NUMBER), F.lit(0)), lambda x: x.cast("double")))
    claim = told.select("query_id", "place", F.array_distinct("cited").alias("cited"), numbers.alias("numbers_"), dates.alias("dates_"))
    # the cited rows of each claim, by id
    each = claim.select("query_id", "place", F.explode("cited").alias("evidence_id"))
    rows = selected.select("query_id", "evidence_id", "ts", "value", F.lit(True).alias("there"))
    per = each.join(rows, ["query_id", "evidence_id"], "left").groupBy("query_id", "place").agg(
        F.collect_list("value").alias("values"), F.collect_list(F.when(F.col("there").isNull(), F.col("evidence_id").cast("string"))).alias("strange"), F.flatten(F.collect_list(F.array_compact(F.array(_day(F.col("ts")), F.date_format("ts", "dd/MM/yyyy"))))).alias("days")
    )
    # a question has a handful of facts
    known = facts.filter("value is not null").groupBy("query_id").agg(F.collect_list(F.struct("value", "contributors")).alias("facts"))
    both = claim.join(per, ["query_id", "place"], "left").join(known, "query_id", "left")
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    usable = F.filter(F.coalesce("facts", F.array().cast(known.schema["facts"].dataType)), lambda f: inside(f["contributors"], F.col("cited")) | inside(F.col("cited"), f["contributors"]))
    allowed = F.concat(F.coalesce("values", F.array().cast("array<double>")), F.flatten(F.transform(usable, lambda f: F.array(f["value"], F.round(f["value"], 2), F.round(f["value"], 1)))))
    both = both.withColumn("allowed", allowed)
    close = lambda x: F.exists("allowed", lambda a: F.abs(F.abs(x) - F.abs(a)) <= within + 1e-9)
    loose = F.filter("numbers_", lambda x: ~x.isin(*IGNORED) & ~close(x))
    wrong = F.array_except("dates_", F.coalesce("days", F.array().cast("array<string>")))
    none, strange = F.size("cited") == 0, F.size(F.coalesce("strange", F.array().cast("array<string>"))) > 0
    reasons = (
        F.when(none, F.array(F.lit("no evidence cited"))).when(strange, F.transform("strange", lambda i: F.concat(F.lit("evidence not selected: "), i)))
        .otherwise(F.concat(F.transform(loose, lambda x: F.concat(F.lit("number not in evidence: "), shown(x))), F.transform(wrong, lambda d: F.concat(F.lit("date not in evidence: "), d))))
    )
    judged = both.select("query_id", "place", F.array_sort(F.array_distinct(reasons)).alias("reasons"))
    return told.drop("claim_").join(judged, ["query_id", "place"]).withColumn("grounded", F.size("reasons") == 0)


def audit(verified: DataFrame, selected: DataFrame) -> DataFrame:
    """query_id, claims, grounded, unsupported, grounding_rate, utilisation (share of the selected rows that grounded claims cite),
    hallucination. ``verified`` is kept, as it is read twice."""
    verified = kept(verified.select("query_id", "grounded", "cited"), "verified")
    per = verified.groupBy("query_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("grounded").alias("grounded"))
    cited = verified.filter("grounded").select("query_id", F.explode("cited").alias("evidence_id")).distinct()
    used = selected.select("query_id", "evidence_id").distinct().join(cited.withColumn("used", F.lit(1)), ["query_id", "evidence_id"], "left").groupBy("query_id").agg(F.count("used").alias("used"), F.count(F.lit(1)).alias("selected"))
    both = per.join(used, "query_id", "left")
    return both.select("query_id", "claims", "grounded", (F.col("claims") - F.col("grounded")).alias("unsupported"), F.round(F.col("grounded") / F.col("claims"), 6).alias("grounding_rate"),
                       F.round(F.coalesce(F.col("used") / F.col("selected"), F.lit(1.0)), 6).alias("utilisation"), (F.col("claims") > F.col("grounded")).alias("hallucination"))
