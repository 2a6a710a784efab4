"""Scalar functions: Column in, Column out, all built-in expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no content in questions and records: fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "what", "which", "with")


def let(x: Column, of) -> Column:
    """``of(x)`` with x evaluated once; within lambda functions Spark would evaluate it wherever it stands."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def tokenize(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and digits of at least two characters that aren't stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def normalise_name(s: Column) -> Column:
    """Bullets, brackets and punctuation go, common abbreviations are spelled out, blanks collapse."""
    s = F.lower(s)
    for pattern, new in ((r"\([^)]*\)|\[[^\]]*\]", " "), (r"[-*.,;:/_#|]+", " "), (r"\bhb\b|\bhgb\b", "hemoglobin"), (r"\bhaem", "hem"), (r"\bchol\b", "cholesterol"), (r"\bs\b ", ""), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, new)
    return F.trim(s)


def round_half(x: Column | str, places: int) -> Column:
    """Rounded half away from zero, by the number's first ten decimals: the noise of a sum in another order doesn't decide ties.
    Numbers outside of decimal(38, 10) are rounded as they are."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.round(x.try_cast("decimal(38,10)"), places).cast("double"), F.round(x, places))


def parse_number(s: Column) -> Column:
    """Text with a decimal comma or point to decimal(10,4); anything else is null."""
    return F.replace(F.trim(s), F.lit(","), F.lit(".")).try_cast("decimal(10,4)")


def parse_numeric_value(s: Column) -> Column:
    """The number after leading comparison signs."""
    return F.regexp_replace(F.trim(s), r"^[<>=~ ]+", "").try_cast("double")


#: English names of months, whole and short: fixed values.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SHORT_MONTHS = {**{m[:3]: i + 1 for i, m in enumerate(MONTHS)}, "sept": 9}


def parse_date_any(s: Column) -> Column:
    """The date at the text's start: three parts between signs or blanks, as year-month-day, day-month-year (month first where only that
    can be), or with a month's name in second or first place. Two-digit years are from 1950 to 2049; 1900 to 2100."""
    named = F.create_map(*(F.lit(x) for pair in {**{m: i + 1 for i, m in enumerate(MONTHS)}, **SHORT_MONTHS}.items() for x in pair))
    field = lambda **of: F.named_struct(*(x for name, c in of.items() for x in (F.lit(name), c)))

    def cells(parts: Column) -> Column:
        digits = lambda i, most: F.regexp_extract(F.try_element_at(parts, F.lit(i)), rf"^\d{{1,{most}}}", 0).try_cast("int")
        month = lambda i: F.element_at(named, F.try_element_at(parts, F.lit(i)))
        first = F.regexp_like(F.try_element_at(parts, F.lit(1)), F.lit(r"^\d{4}"))
        return field(a=digits(1, 4), b=digits(2, 2), c=digits(3, 4), third=digits(3, 2), m1=month(1), m2=month(2), first=first)

    def named_parts(x: Column) -> Column:
        a, b, first, swap = x["a"], x["b"], x["first"], (x["b"] > 12) & (x["a"] <= 12)
        day = F.when(first, x["third"]).when(x["m2"].isNotNull(), a).when(x["m1"].isNotNull(), b).when(swap, b).otherwise(a)
        number = F.when(first, F.coalesce(x["m2"], b)).when(x["m2"].isNotNull(), x["m2"]).when(x["m1"].isNotNull(), x["m1"]).when(swap, a).otherwise(b)
        year = F.when(first, a).otherwise(x["c"])
        return field(day=day, number=number, year=F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year))

    def found(x: Column) -> Column:
        day, number, year = x["day"], x["number"], x["year"]
        return F.when(number.between(1, 12) & day.between(1, 31) & year.between(1900, 2100), F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, number, day), F.lit("yyyy-MM-dd")).cast("date"))

    return let(let(let(F.split(F.lower(F.trim(s)), r"[-/.,\s]+"), cells), named_parts), found)


#: Which date of a document speaks for it: kind -> (rank, confidence): fixed values.
DATE_RANKS = {"collection": (1, 0.95), "test": (2, 0.9), "result": (3, 0.85), "report": (4, 0.75), "unlabelled": (5, 0.5), "administrative": (99, 0.0)}


def date_rank(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, (r, _) in DATE_RANKS.items() for x in (k, r))), kind), F.lit(99))


def date_confidence(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, (_, c) in DATE_RANKS.items() for x in (k, c))), kind)


def max_scale(score: str, query: str | list[str]) -> Column:
    top = F.max(score).over(Window.partitionBy(query))
    return F.when(top > 0, F.col(score) / top).otherwise(0.0)


def minmax_scale(score: str, query: str) -> Column:
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    below = norm(a) * norm(b)
    return F.when(below > 0, dot(a, b) / below).otherwise(0.0)


def band(x: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """Name of the first cut that x reaches; cuts from the highest down."""
    out = F.when(x >= cuts[0][0], cuts[0][1])
    for cut, name in cuts[1:]:
        out = out.when(x >= cut, name)
    return out.otherwise(last)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def confidence_from_missing(share: Column) -> Column:
    return clamp(1.0 - 0.6 * share, 0.2, 1.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > 1e-9, a / b)


def hash_bucket(i: Column, seed: int, buckets: int = 10000) -> Column:
    """First 32 bits of SHA-256 of seed:id, modulo buckets."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), i.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def pseudonym(v: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 with a key of up to 64 bytes: two nested digests over the padded key."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ p for k in key)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, v.cast("string").cast("binary")), 256))), 256)


def redact(text: Column, names: Sequence[str]) -> Column:
    """Values of named fields (name=value, name: value) become [redacted]."""
    return F.regexp_replace(text, rf"(?i)\b({'|'.join(names)})(\s*[:=]\s*)\S+", "$1$2[redacted]")


#: Hard words and their softer forms, in order: fixed values.
SOFTER = (("dangerous", "worth discussing"), ("severe", "marked"), ("alarming", "notable"), ("you must", "you may want to"))


def soften_tone(text: Column) -> Column:
    for hard, soft in SOFTER:
        text = F.regexp_replace(text, f"(?i){hard}", soft)
    return text


def tone_violation(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(h for h, _ in SOFTER))


def key_sentences(text: Column, n: int, least: int = 20) -> Column:
    """The first n sentences of more than ``least`` characters."""
    return F.slice(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > least), 1, n)


def age_on(day: Column, birth: Column) -> Column:
    return F.floor(F.months_between(day, birth) / 12).cast("int")


def is_minor(day: Column, birth: Column) -> Column:
    return age_on(day, birth) < 18


def keyword_hit(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def lexical_doc(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def extraction_confidence(line: Column, unit: Column, ref: Column) -> Column:
    """How whole a row is: fixed values for having a unit, a range and more than twelve characters."""
    score = 0.55 + F.when(unit.isNotNull(), 0.2).otherwise(0.0) + F.when(ref.isNotNull(), 0.15).otherwise(0.0) + F.when(F.length(line) > 12, 0.05).otherwise(0.0)
    return F.round(F.least(score, F.lit(0.99)), 3)


def explanation(status: Column, name: Column, value: Column, templates: DataFrame | None = None) -> Column:
    """A sentence for each status."""
    text = F.create_map(*(F.lit(x) for k, v in {"high": "%s is %s, above its range.", "low": "%s is %s, below its range.", "normal": "%s is %s, in its range."}.items() for x in (k, v)))
    form = F.coalesce(F.element_at(text, status), F.lit("%s is %s; its range isn't known."))
    return F.replace(F.regexp_replace(form, "%s is", F.concat(name, F.lit(" is"))), F.lit("%s"), value.cast("string"))


def word_error_accuracy(ref: Column, hyp: Column) -> Column:
    """1 - word error rate, at least 0. Each word becomes one character (its place among both texts' words), so that
    levenshtein counts words."""
    spell = lambda ws, both: F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, w) + 0x10000), 8, "0")), "UTF-32")), "")
    accuracy = lambda a, b, both: F.greatest(F.lit(0.0), 1.0 - F.levenshtein(spell(a, both), spell(b, both)) / F.greatest(F.size(a), F.lit(1)))
    texts = F.named_struct(F.lit("a"), F.split(ref, r"\s+"), F.lit("b"), F.split(hyp, r"\s+"))
    # the distinct words are found once, not for each word
    return let(texts, lambda x: let(F.array_distinct(F.concat(x["a"], x["b"])), lambda both: accuracy(x["a"], x["b"], both)))


SQL_FUNCTIONS = {
    "parse_numeric_value(s STRING) RETURNS DOUBLE": "try_cast(regexp_replace(trim(s), '^[<>=~ ]+', '') as double)",
    "clamp(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "least(greatest(x, low), high)",
    "range_status(v DOUBLE, low DOUBLE, high DOUBLE) RETURNS STRING": "case when v is null or (low is null and high is null) then 'unknown' when v < low then 'low' when v > high then 'high' else 'normal' end",
}


def register_sql(spark) -> None:
    """SQL names for functions; Catalyst inlines their bodies."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
