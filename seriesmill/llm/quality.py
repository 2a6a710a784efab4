"""Quality rules by distribution divergence, in DataFrame functions alone.

Base counts come from each whole text. The method then compares two histograms of a document with its language's
reference by Jensen-Shannon distance (base 2, 0 to 1): shares of character classes, and shares of the language's most
frequent short words plus "any other". References are learned from all documents of the language. Guards: a histogram
of few words says little, so each comparison has a least length; a language with few documents has no reference, and one
without short words of lower-case or caseless letters has one for characters alone. Where there is no reference (also: null
language) the distance is null, and the rest decides.

n_repeat_words compares windows by the 64-bit hash of their words.

Defined cases: null text has no words and fails the base rule, as does an empty one; a null language is kept by the
method; repeated rows get equal results, one each; an empty table gives an empty result; ties in word frequency go to
the smaller word; other columns are ignored by ``judge`` and passed through by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

SYMBOLS = "[#*$%&|<>]"
#: Character classes, taken out of the text one after the other; what is left is the last class.
CLASSES = ("[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+", "[#*$%&|<>]+", r"[^\x00-\x7F]+")
WINDOW = 8
LEAST_WORDS, MOST_REPEAT = 20, 30
#: Common words: the most frequent lower-case words of at most so many letters, per language.
COMMON, COMMON_LETTERS = 16, 5
LETTERS = r"[\p{Ll}\p{Lo}\p{M}]"
LEAST_DOCUMENTS = 20
#: Least words of a document, and the distance above which it is rejected.
CHARS_FROM, CHARS_MOST = 50, 0.30
WORDS_FROM, WORDS_MOST = 100, 0.28


def _with_words(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "lang", text.alias("text"), *carry).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``words``: hash each window of 8 by doubling, sort, mark equal neighbours, and add
    up what the marked windows cover."""
    pair = lambda a, b: F.xxhash64(a, b)
    shift = lambda c, by: F.zip_with(F.slice(c, 1, F.size(c) - by), F.slice(c, by + 1, F.size(c) - by), pair)
    long_ = F.size("words") > WINDOW
    df = df.withColumn("h", F.when(long_, F.transform("words", lambda w: F.xxhash64(w))))
    for by in (1, 2, 4):
        df = df.withColumn("h", shift(F.col("h"), by))
    none = F.coalesce(F.size(F.array_distinct("h")) == F.size("h"), F.lit(True))
    df = df.withColumn("s", F.when(~none, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda x, i: F.coalesce(F.get("s", i - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["x"] == x["x"], F.lit(False))
    df = df.withColumn("at", F.sort_array(F.transform(F.filter("s", twin), lambda x: x["i"])))
    covers = F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covers, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("h", "s", "at")


def measures(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, words, the base counts, base_failed, ``chars`` (a count for each class) and the columns to carry."""
    df = _repeats(_with_words(docs, carry))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("lines", lines).withColumn("n_words", F.size("words").cast("long"))
    rest = [F.col("text")]
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"left{k}", F.regexp_replace(rest[-1], pattern, ""))
        rest.append(F.col(f"left{k}"))
    n = [F.char_length(c) for c in rest]
    chars = F.array(*(a - b for a, b in zip(n, n[1:], strict=False)), n[-1])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT * F.col("n_words"))
    return df.select(
        "doc_id", "lang", "words", "n_words",
        (F.char_length("text") - F.get(chars, F.lit(1))).cast("long").alias("word_chars"),
        F.get(chars, F.lit(5)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), chars.alias("chars"), *carry,
    )


def references(docs: DataFrame) -> DataFrame:
    """One row per language with enough documents: common (words), word_shares (theirs, then all others'), char_shares."""
    df = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    n = [F.char_length("text")]
    left = F.col("text")
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"left{k}", F.regexp_replace(left, pattern, ""))
        left = F.col(f"left{k}")
        n.append(F.char_length(left))
    counts = [F.sum(a - b) for a, b in zip(n, n[1:], strict=False)] + [F.sum(n[-1])]
    words = F.sum(F.regexp_count("text", F.lit(WORD)))
    per = df.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), words.alias("all_words"), F.array(*counts).alias("chars"))
    short = df.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    short = short.filter(F.col("word").rlike(rf"^{LETTERS}{{1,{COMMON_LETTERS}}}$"))
    best = short.groupBy("lang", "word").count().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word")))
    best = best.filter(F.col("place") <= COMMON).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "count"))).alias("best"))
    share = lambda c, total: c.cast("double") / total
    known = F.aggregate("best", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    out = per.filter(F.col("n_docs") >= LEAST_DOCUMENTS).join(best, "lang", "left")
    return out.select(
        "lang",
        F.transform("best", lambda x: x["word"]).alias("common"),
        F.concat(F.transform("best", lambda x: share(x["count"], F.col("all_words"))), F.array(share(F.col("all_words") - known, F.col("all_words")))).alias("word_shares"),
        F.transform("chars", lambda c: share(c, F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x))).alias("char_shares"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays: the root of the mean divergence from their midpoint;
    null where either is null."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(p, q, lambda a, b: (term(a, (a + b) / 2) + term(b, (a + b) / 2)) / 2)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x, lambda a: F.sqrt(F.greatest(a, F.lit(0.0))))


def judge(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, n_words, the base counts, base_failed, kept, js_chars, js_words, carried ones."""
    ref = settle(references(docs), "quality-references").withColumnRenamed("lang", "ref_lang")
    df = measures(docs, carry).join(ref, F.col("lang") == F.col("ref_lang"), "left")
    hits = F.when((F.col("n_words") >= WORDS_FROM) & ~F.col("base_failed"), F.filter("words", lambda w: F.array_contains("common", w)))
    df = df.withColumn("hits", hits)
    counts = F.transform("common", lambda c: F.size(F.filter("hits", lambda h: h == c)).cast("double"))
    df = df.withColumn("counts", F.concat(counts, F.array((F.col("n_words") - F.size("hits")).cast("double"))))
    words = F.when(F.col("hits").isNotNull(), js_distance(F.transform("counts", lambda c: c / F.col("n_words")), F.col("word_shares")))
    total = F.aggregate("chars", F.lit(0), lambda a, x: a + x)
    chars = F.when(F.col("n_words") >= CHARS_FROM, js_distance(F.transform("chars", lambda c: c.cast("double") / total), F.col("char_shares")))
    df = df.withColumn("js_words", words).withColumn("js_chars", chars)
    odd = F.coalesce(F.col("js_words") > WORDS_MOST, F.lit(False)) | F.coalesce(F.col("js_chars") > CHARS_MOST, F.lit(False))
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return df.select("doc_id", *counted, (~F.col("base_failed") & ~odd).alias("kept"), "js_chars", "js_words", *carry)


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("js_chars", "js_words")


def keep(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects: all columns as they are, and no shuffle of texts."""
    whole = docs.select("doc_id", "text", "lang", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    # a filter on the verdict would be pushed below the steps that make it, and repeat each of them in its condition
    told = judge(whole, ("row_",)).select(F.explode_outer(F.when(F.col("kept"), F.array("row_"))).alias("row_"))
    return told.filter("row_ is not null").select("row_.*")


SQL = r"""
with base as (
  select doc_id, lang, text is not null as has_text, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), windows as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as w
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from base)
), repeats as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) as p
        from (select doc_id, i, count(*) over (partition by doc_id, w) as c from windows) where c > 1)
  group by doc_id
), lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l from base
), counted as (
  select b.doc_id, b.lang, b.has_text, b.words, len(b.words) as n_words,
         length(regexp_replace(b.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(regexp_replace(b.text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         len(l.l) - len(list_distinct(l.l)) as n_dup_lines,
         coalesce(r.n_repeat_words, 0) as n_repeat_words,
         [length(b.text) - length(regexp_replace(b.text, '[a-z]+', '', 'g')),
          length(b.text) - length(regexp_replace(b.text, '[\x20\x09-\x0D]+', '', 'g')),
          length(b.text) - length(regexp_replace(b.text, '[A-Z]+', '', 'g')),
          length(b.text) - length(regexp_replace(b.text, '[0-9]+', '', 'g')),
          length(b.text) - length(regexp_replace(b.text, '[.,;:!?''"()-]+', '', 'g')),
          length(regexp_replace(b.text, '[^#*$%&|<>]+', '', 'g')),
          length(b.text) - length(regexp_replace(b.text, '[^\x00-\x7F]+', '', 'g'))] as seven,
         length(b.text) as n
  from base b join lines l using (doc_id) left join repeats r using (doc_id)
), measured as (
  select * exclude (seven, n), list_append(seven, n - list_sum(seven)::bigint) as chars,
         n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed
  from counted
), totals as (
  select lang, sum(n_words) as all_words, list_transform(range(1, 9), lambda k: 0) as zero,
         [sum(chars[1]), sum(chars[2]), sum(chars[3]), sum(chars[4]), sum(chars[5]), sum(chars[6]), sum(chars[7]), sum(chars[8])] as c
  from measured where lang is not null and has_text group by lang having count(*) >= 20
), best as (
  select lang, list(word order by place) as common, list(c order by place) as counts
  from (select lang, word, c, row_number() over (partition by lang order by c desc, word) as place
        from (select lang, word, count(*) as c from (select lang, unnest(words) as word from measured where lang is not null)
              where regexp_matches(word, '^[\p{Ll}\p{Lo}\p{M}]{1,5}$') group by lang, word))
  where place <= 16 group by lang
), ref as (
  select t.lang, b.common,
         list_append(list_transform(b.counts, lambda x: x::double / t.all_words), (t.all_words - list_sum(b.counts))::double / t.all_words) as word_shares,
         list_transform(t.c, lambda x: x::double / list_sum(t.c)) as char_shares
  from totals t left join best b using (lang)
), compared as (
  select m.*, r.common, r.word_shares as qw, r.char_shares as qc,
         list_transform(m.chars, lambda x: x::double / list_sum(m.chars)) as pc,
         list_transform(r.common, lambda c: len(list_filter(m.words, lambda w: w = c))::double / m.n_words) as shares
  from measured m left join ref r on m.lang = r.lang
), distances as (
  select *, list_append(shares, 1 - list_sum(shares)) as pw from compared
), judged as (
  select *,
    case when n_words >= 50 then sqrt(greatest(0, list_sum(list_transform(list_zip(pc, qc), lambda z:
      (case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end
     + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end) / 2)))) end as js_chars,
    case when n_words >= 100 then sqrt(greatest(0, list_sum(list_transform(list_zip(pw, qw), lambda z:
      (case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end
     + case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end) / 2)))) end as js_words
  from distances
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not coalesce(js_words > 0.28, false) and not coalesce(js_chars > 0.30, false) as kept
from judged
"""
