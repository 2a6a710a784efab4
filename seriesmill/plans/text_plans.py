"""Queries of scalar functions, text and retrieval operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import answers
from ..operators import relational as rel
from ..operators import retrieval as ret
from ..operators import series
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql=None):
    _add_there(name, run, sql or "")
    QUERIES[name] = _Q.pop(name)
    text = _O.pop(name)
    if sql:
        ORACLE[name] = text


_STOP = ", ".join(f"'{w}'" for w in fn.STOP_WORDS)
_TOK = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 and w not in ({_STOP}))"
_add("f1_tokenize", lambda t: t("documents").select("doc_id", fn.tokenize(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest")),
     f"select doc_id, len({_TOK}) as n, md5(array_to_string({_TOK}, ' ')) as digest from documents")
_add("f2_normalise_name", lambda t: t("part").select("p_partkey", fn.normalise_name(F.concat("p_name", F.lit(" - (x) Hb/"), "p_brand")).alias("n")),
     r"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' - (x) Hb/' || p_brand), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[-*.,;:/_#|]+', ' ', 'g'), '\bhb\b|\bhgb\b', 'hemoglobin', 'g'), '\bhaem', 'hem', 'g'), '\bchol\b', 'cholesterol', 'g'), '\bs\b ', '', 'g'), '\s+', ' ', 'g')) as n from part")
_add("f3_parse_number", lambda t: t("orders").select("o_orderkey", fn.parse_number(F.when(F.col("o_orderkey") % 4 == 0, "abc").otherwise(F.replace((F.col("o_totalprice") / 10).cast("decimal(18,6)").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))).cast("double").alias("v")),
     "select o_orderkey, case when o_orderkey % 4 <> 0 then round((o_totalprice / 10)::decimal(18, 6), 2)::double end as v from orders")
_add("f4_parse_numeric_value", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", fn.parse_numeric_value(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "<= ").otherwise(" "), F.col("l_quantity").cast("string"))).alias("v")), "select l_orderkey, l_linenumber, l_quantity as v from lineitem")
_add("f5_parse_date_any", lambda t: t("orders").select("o_orderkey", fn.parse_date_any(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))).cast("string").alias("d")), "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders")
_add("f6_date_rank", lambda t: t("events").groupBy(fn.date_rank(F.when(F.col("event_type") == "click", "collection").when(F.col("event_type") == "view", "administrative").otherwise("report")).alias("rank")).count(), "select case event_type when 'click' then 1 when 'view' then 99 else 4 end as rank, count(*) as count from events group by 1")
_add("f7_scales", lambda t: t("customer").select("c_custkey", F.round(fn.max_scale("c_acctbal", "c_nationkey"), 6).alias("by_max"), F.round(fn.minmax_scale("c_acctbal", "c_nationkey"), 6).alias("by_range")),
     "select c_custkey, round(case when max(c_acctbal) over w > 0 then c_acctbal / max(c_acctbal) over w else 0 end, 6) as by_max, round(case when max(c_acctbal) over w > min(c_acctbal) over w then (c_acctbal - min(c_acctbal) over w) / (max(c_acctbal) over w - min(c_acctbal) over w) else 0 end, 6) as by_range from customer window w as (partition by c_nationkey)")
_DOT = "list_sum(list_transform(embedding, lambda x: x::double * x::double))"
_add("f8_norm", lambda t: t("embeddings").select("vec_id", F.round(fn.norm(F.col("embedding")), 6).alias("norm"), F.round(fn.cosine(F.col("embedding"), F.col("embedding")), 6).alias("self")), f"select vec_id, round(sqrt({_DOT}), 6) as norm, 1.0::double as self from embeddings")
_add("f9_band", lambda t: t("customer").groupBy(fn.band(F.col("c_acctbal"), [(8000.0, "high"), (4000.0, "middle"), (0.0, "low")], "negative").alias("band")).count(), "select case when c_acctbal >= 8000 then 'high' when c_acctbal >= 4000 then 'middle' when c_acctbal >= 0 then 'low' else 'negative' end as band, count(*) as count from customer group by 1")
_add("f10_clamp", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(fn.confidence_from_missing(F.col("l_discount") * 12), 6).alias("c")), "select l_orderkey, l_linenumber, round(least(greatest(1 - 0.6 * l_discount * 12, 0.2), 1.0), 6) as c from lineitem")
_add("f11_ratio", lambda t: t("lineitem").select("l_orderkey", "l_linenumber", F.round(fn.ratio(F.col("l_extendedprice"), F.col("l_tax")), 4).alias("r")), "select l_orderkey, l_linenumber, round(case when abs(l_tax) > 1e-9 then l_extendedprice / l_tax end, 4) as r from lineitem")
_add("f12_hash_bucket", lambda t: t("customer").select("c_custkey", fn.hash_bucket(F.col("c_custkey"), 42).alias("bucket")), "select c_custkey, ('0x' || substr(sha256('42:' || c_custkey), 1, 8))::bigint % 10000 as bucket from customer")
_add("f13_pseudonym", lambda t: t("customer").select("c_custkey", fn.pseudonym(F.col("c_custkey"), b"pepper").alias("p")))
_add("f14_redact", lambda t: t("customer").select("c_custkey", fn.redact(F.concat(F.lit("name="), "c_name", F.lit(" seg: "), "c_mktsegment"), ["name", "seg"]).alias("r")), "select c_custkey, 'name=[redacted] seg: [redacted]' as r from customer")
_add("f15_soften_tone", lambda t: t("orders").select("o_orderkey", F.concat(F.when(F.col("o_totalprice") > 100000, "Severe ").otherwise("mild "), "o_orderpriority").alias("s")).select("o_orderkey", fn.soften_tone(F.col("s")).alias("soft"), fn.tone_violation(F.col("s")).alias("bad")),
     "select o_orderkey, case when o_totalprice > 100000 then 'marked ' else 'mild ' end || o_orderpriority as soft, o_totalprice > 100000 as bad from orders")
_add("f16_key_sentences", lambda t: t("documents").select("doc_id", F.array_join(fn.key_sentences(F.col("text"), 3), "|").alias("s")),
     r"select doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 20)[1:3], '|') as s from documents")
_add("f17_age_on", lambda t: t("orders").select("o_orderkey", fn.age_on(F.to_date("o_orderdate"), F.lit("1978-06-15").cast("date")).cast("long").alias("age"), fn.is_minor(F.to_date("o_orderdate"), F.lit("1978-06-15").cast("date")).alias("minor")), "select o_orderkey, date_sub('year', date '1978-06-15', o_orderdate::date) as age, date_sub('year', date '1978-06-15', o_orderdate::date) < 18 as minor from orders")
_add("f18_keyword_hit", lambda t: t("documents").filter(fn.keyword_hit(F.col("text"), F.array(F.lit("Thing"), F.lit("eaux")))).select("doc_id"), "select doc_id from documents where contains(lower(text), 'thing') or contains(lower(text), 'eaux')")
_add("f19_explanation", lambda t: t("part").select("p_partkey", fn.explanation(F.when(F.col("p_size") > 40, "high").when(F.col("p_size") < 5, "unknown").otherwise("normal"), F.col("p_brand"), F.col("p_size")).alias("e")),
     "select p_partkey, p_brand || ' is ' || p_size || case when p_size > 40 then ', above its range.' when p_size < 5 then '; its range isn''t known.' else ', in its range.' end as e from part")
_add("f20_lexical_doc", lambda t: t("part").select("p_partkey", fn.lexical_doc(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("d")), "select p_partkey, concat_ws(' ', p_name, p_brand, p_type) as d from part")
_add("f21_extraction_confidence", lambda t: t("part").select("p_partkey", F.round(fn.extraction_confidence(F.col("p_name"), F.when(F.col("p_size") > 10, "u"), F.when(F.col("p_size") > 30, "r")), 4).alias("c")), "select p_partkey, round(least(0.55 + case when p_size > 10 then 0.2 else 0 end + case when p_size > 30 then 0.15 else 0 end + case when length(p_name) > 12 then 0.05 else 0 end, 0.99)::double, 3) as c from part")
_add("f22_word_error", lambda t: t("conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before is not null")
     .select("conv_id", "turn", F.round(fn.word_error_accuracy(F.col("before"), F.col("text")), 6).alias("a")))
_add("f23_json_fields", lambda t: t("events").groupBy(F.get_json_object("props", "$.page").alias("page")).agg(F.count(F.lit(1)).alias("n")), "select json_extract_string(props, '$.page') as page, count(*) as n from events group by 1")


def _sql_functions(t):
    fn.register_sql(t.spark)
    t("lineitem").createOrReplaceTempView("lineitem_h4")
    return t.spark.sql("select l_orderkey, l_linenumber, range_status(l_quantity, 10, 40) as status, clamp(l_quantity, 5, 45) as c, parse_numeric_value('< ' || l_linenumber) as v from lineitem_h4")


_add("h4_sql_functions", _sql_functions, "select l_orderkey, l_linenumber, case when l_quantity < 10 then 'low' when l_quantity > 40 then 'high' else 'normal' end as status, least(greatest(l_quantity, 5), 45)::double as c, l_linenumber::double as v from lineitem")
# --- text and retrieval ---
_add("x1_chunks", lambda t: ret.chunks(t("documents"), "doc_id", "text").select("doc_id", "chunk", F.md5("text").alias("digest")),
     r"""with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents), c as (select doc_id, w, unnest(range(0, greatest(len(w) - 51, 0) + 1, 250)) as start from w where len(w) > 0)
  select doc_id, start // 250 as chunk, md5(array_to_string(w[start + 1:start + 300], ' ')) as digest from c""")
_P = f"""d as (select doc_id, {_TOK} as w from documents), p as (select doc_id, len(w) as length, unnest(w) as term from d), f as (select doc_id, term, length, count(*) as tf from p group by 1, 2, 3),
  q as (select item_id as query_id, unnest({_TOK}) as term from benchmark), qt as (select query_id, term, count(*) as qtf from q group by 1, 2), s as (select count(*) as n, avg(len(w)) as a from d), df as (select term, count(*) as df from f group by 1),
  b as (select query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) as score from qt join f using (term) join df using (term), s group by 1, 2)"""


def _bm25(t):
    return ret.bm25(t("benchmark").select(F.col("item_id").alias("query_id"), "text"), t("documents"))




def _top(df, k=5):
    return rel.topk_positive(df, "query_id", k, "score", "doc_id")


_add("x13_bm25", lambda t: _top(_bm25(t)).select("query_id", "doc_id", "score", "rank"), f"with {_P} select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b) where rank <= 5")
_add("x13_bm25_scoped", lambda t: _top(ret.bm25(
         t("conversations").filter("turn = 0").select(F.col("conv_id").alias("query_id"), "conv_id", "text"),
         t("conversations").filter("turn > 0").select(F.col("turn").alias("doc_id"), "conv_id", "text"), scope=["conv_id"]), 3)
     .select("query_id", "doc_id", "score", "rank"),
     f"""with d as (select conv_id, turn as doc_id, {_TOK} as w from conversations where turn > 0), s as (select conv_id, count(*) as n, avg(len(w)) as a from d group by 1),
  p as (select conv_id, doc_id, len(w) as length, unnest(w) as term from d), f as (select conv_id, doc_id, term, length, count(*) as tf from p group by 1, 2, 3, 4), df as (select conv_id, term, count(*) as df from f group by 1, 2),
  q as (select conv_id, unnest({_TOK}) as term from conversations where turn = 0), qt as (select conv_id, term, count(*) as qtf from q group by 1, 2),
  b as (select conv_id as query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) as score from qt join f using (conv_id, term) join df using (conv_id, term) join s using (conv_id) group by 1, 2)
  select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b) where rank <= 3""")
_ROW = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as e from embeddings)"
_KNN = f"{_ROW}, k as (select q.vec_id as query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 6) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from k)"
_add("x15_knn", lambda t: ret.knn(t("embeddings").filter("vec_id % 100 = 0"), t("embeddings"), 10).select("query_id", "vec_id", "rank"), f"with {_KNN} select query_id, vec_id, rank from r where rank <= 10")


def _both(t):
    """Two scores of each match: BM25 and the document's length."""
    return ret.kept(_bm25(t).join(t("documents").select("doc_id", F.col("n_chars").cast("double").alias("n")).hint("shuffle_hash"), "doc_id"), "both")


_TWO = f"{_P}, l as (select query_id, doc_id, n_chars::double as score from b join documents using (doc_id))"
_add("x17_fuse_weighted", lambda t: _top(ret.fuse_columns(_both(t), {"score": 0.7, "n": 0.3}), 3).select("query_id", "doc_id", "rank"), f"""with {_TWO}, u as (select query_id, doc_id, 0.7 * score / max(score) over (partition by query_id) as p from b union all select query_id, doc_id, 0.3 * score / max(score) over (partition by query_id) from l),
  f2 as (select query_id, doc_id, round(sum(p), 6) as score from u group by 1, 2) select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f2) where rank <= 3""")
_add("x18_fuse_rrf", lambda t: _top(ret.fuse_rank_columns(_both(t), ["score", "n"], most=3), 3).select("query_id", "doc_id", "rank"), f"""with {_TWO}, a1 as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as r from b), a2 as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as r from l),
  f2 as (select a1.query_id, a1.doc_id, round(1.0 / (60 + a1.r) + 1.0 / (60 + a2.r), 8) as score from a1 join a2 on a1.query_id = a2.query_id and a1.doc_id = a2.doc_id) select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f2) where rank <= 3""")
_RULES = [(1, "contact", r"@|\+[0-9]"), (2, "shout", r"[A-Z]{6,}"), (3, "table", r" \| ")]
_add("x7_match_rules", lambda t: ret.match_rules(t("documents"), "doc_id", "text", _RULES).groupBy("category").count(), r"select case when regexp_matches(text, '@|\+[0-9]') then 'contact' when regexp_matches(text, '[A-Z]{6,}') then 'shout' when regexp_matches(text, ' \| ') then 'table' end as category, count(*) as count from documents group by 1")
_TOPICS = {"french": ["eaux", "leur"], "german": ["schaft", "ung "], "english": ["the ", "ing "]}
_add("x8_detect_topics", lambda t: ret.detect_topics(t("documents"), "doc_id", "text", _TOPICS).select("doc_id", F.array_join("topics", ",").alias("topics"), F.round(ret.topic_boost(F.col("topics"), F.array(F.lit("french"), F.lit("german"), F.lit("english"))), 4).alias("boost")),
     "select doc_id, concat_ws(',', case when e then 'english' end, case when f then 'french' end, case when g then 'german' end) as topics, round(least((e::int + f::int + g::int) * 0.15, 0.35)::double, 4) as boost from (select doc_id, regexp_matches(lower(text), 'the |ing ') as e, regexp_matches(lower(text), 'eaux|leur') as f, regexp_matches(lower(text), 'schaft|ung ') as g from documents)")
_add("x19_concept_score", lambda t: t("part").select("p_partkey", ret.concept_score(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.lower("p_brand"), F.when(F.col("p_size") > 10, F.lit("Brand#13"))).alias("s")),
     "select p_partkey, case when p_size <= 10 then 0.5 when p_brand = 'Brand#13' or p_type = 'Brand#13' then 1.0 when p_name = 'Brand#13' then 0.95 when lower(p_brand) = 'Brand#13' then 0.9 else 0.0 end::double as s from part")
_add("j10_term_join", lambda t: ret.postings(t("documents"), "doc_id", "text").join(ret.postings(t("benchmark"), "item_id", "text").select("item_id", "term"), "term").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")),
     f"with d as (select doc_id, unnest({_TOK}) as term from documents), f as (select doc_id, term, count(*) as tf from d group by 1, 2), q as (select distinct item_id, unnest({_TOK}) as term from benchmark) select item_id, count(*) as n, sum(tf)::bigint as tf from f join q using (term) group by 1")
_add("j12_contains_join", lambda t: ret.contains_join(t("conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text"), t.spark.createDataFrame([("the",), ("thing",), ("of the",), ("und",)], "name string")).groupBy("name").agg(F.countDistinct("query_id").alias("n")),
     r"with q as (select conv_id || ':' || turn as query_id, lower(text) as low from conversations), n as (select unnest(['the', 'thing', 'of the', 'und']) as name) select name, count(distinct query_id) as n from q, n where list_contains(regexp_extract_all(low, '[a-z0-9]+'), regexp_extract(name, '[a-z0-9]+')) and contains(low, name) group by 1")
_ASK = lambda t: t("benchmark").select(F.col("item_id").alias("query_id"), "text")
_SCORERS = {"lexical": ret.bm25, "coverage": answers.term_coverage}
_COVER = f"""{_P}, qn as (select query_id, count(*) as n from qt group by 1), c as (select query_id, doc_id, round(count(*) / any_value(qn.n), 6) as cover from qt join f using (term) join qn using (query_id) group by 1, 2)"""
_add("x21_retrieve", lambda t: answers.retrieve(_ASK(t), t("documents"), _SCORERS, {"lexical": 0.5, "coverage": 0.5}, 5, t("documents").filter("lang = 'en'")).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank"),
     f"""with {_COVER}, m as (select query_id, doc_id, round(0.0 + score / max(score) over w * 0.5 + cover / max(cover) over w * 0.5, 6) as score from b join c using (query_id, doc_id) window w as (partition by query_id)),
  e as (select m.* from m join documents using (doc_id) where lang = 'en' and score > 0) select query_id, doc_id, round(score, 4) as score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from e) where rank <= 5""")
_add("x21_retrieve_by_rank", lambda t: answers.retrieve(_ASK(t), t("documents"), _SCORERS, {"lexical": 0.5, "coverage": 0.5}, 5, by_rank=True).select("query_id", "doc_id", "rank"),
     f"""with {_COVER}, m as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as r1, row_number() over (partition by query_id order by cover desc, doc_id) as r2 from b join c using (query_id, doc_id)),
  e as (select query_id, doc_id, round(1.0 / (60 + r1) + 1.0 / (60 + r2), 8) as score from m) select query_id, doc_id, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from e) where rank <= 5""")
_SAFETY = [(1, "urgent", "ou[a-z]* .*ou")]
_REPLY = {"urgent": "Please see someone at once."}
_SAID = r"array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 20)[1:3], ' ')"
for _hard, _soft in fn.SOFTER:
    _SAID = f"regexp_replace({_SAID}, '{_hard}', '{_soft}', 'gi')"
_add("x27_answer_table", lambda t: answers.answer_table(_ASK(t), t("documents"), _SAFETY, _REPLY).select(
         "query_id", "flagged", F.md5("answer").alias("digest"), F.array_join(F.transform("citations", lambda c: F.concat(c["index"].cast("string"), F.lit(":"), c["source"])), ",").alias("cited")),
     f"""with {_P}, fl as (select item_id as query_id, regexp_matches(text, '{_SAFETY[0][2]}') as flagged from benchmark),
  r as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from b where score > 0) where rank <= 5),
  c as (select query_id, rank, {_SAID} as said, coalesce(source, '') as source, min(rank) over (partition by query_id, coalesce(source, '')) as idx from r join documents using (doc_id)),
  a as (select query_id, string_agg(said || ' [' || idx || ']', chr(10) || chr(10) order by rank) as body from c group by 1),
  told as (select query_id, string_agg(idx || ':' || source, ',' order by idx) as cited, string_agg('[' || idx || '] ' || source, chr(10) order by idx) as listed from (select distinct query_id, idx, source from c) group by 1)
  select query_id, flagged, md5(case when flagged then '{_REPLY["urgent"]}' when body is null then 'Too little is known to answer this.' else body || chr(10) || chr(10) || 'Sources cited:' || chr(10) || listed end) as digest,
    case when flagged then '' else coalesce(cited, '') end as cited from fl left join a using (query_id) left join told using (query_id)""")
_add("x16_gram_tfidf", lambda t: ret.gram_tfidf(t("conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"]),
     r"""with w as (select conv_id, turn, ' ' || unnest(string_split_regex(lower(text), '[\x20\x09-\x0D]+')) || ' ' as p from conversations),
  s as (select conv_id, turn, p, unnest([3, 4, 5]) as size from w where p <> '  '),
  g as (select conv_id, turn, unnest(list_transform(range(1, length(p) - size + 2), lambda i: substring(p, i, size))) as gram from s where length(p) >= size),
  c as (select conv_id, turn, gram, count(*) as n from g group by all),
  k as (select gram, ln((1 + (select count(*) from conversations)) / (1 + count(*))) + 1 as idf from c group by gram order by sum(n) desc, gram limit 4096),
  r as (select conv_id, turn, gram, (1 + ln(n)) * idf as w from c join k using (gram))
  select conv_id, turn, gram, round(w / sqrt(sum(w * w) over (partition by conv_id, turn)), 6) as weight from r""")
