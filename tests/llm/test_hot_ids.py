"""One id on most rows, and ids that aren't numbers."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from seriesmill.llm import classifier, mixing, tokenfile


def hot(spark, n=3000):
    """Half of all rows have no id, a sixth has id 7, with the same text."""
    kind = F.when(F.col("id") % 2 == 0, F.lit(None).cast("long")).when(F.col("id") % 6 == 1, 7).otherwise(F.col("id"))
    text = F.when(F.col("id") % 6 == 1, "same words here").otherwise(F.concat(F.lit("text "), F.repeat(F.lit("word "), (F.col("id") % 9).cast("int")), F.col("id").cast("string")))
    return spark.range(n).select(kind.alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))


def test_blocks_don_t_fill_with_one_id(spark):
    docs = hot(spark, 6000)
    keys = mixing.spread_keys(mixing.settle(docs.select("doc_id", "source", F.lit(1).cast("long").alias("size")), "sizes"), 7)
    assert keys.count() == 6000
    assert keys.groupBy("h").count().agg(F.max("count")).first()[0] <= 1.4 * mixing.HOT_ROWS
    got = mixing.mix(docs, block=300)
    assert got.count() == 6000
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.02 * r["target"] for r in per)
    assert mixing.take(docs, block=300).count() == got.agg(F.sum("copies")).first()[0]


def rows_in_order(df):
    return sorted(((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"]) for r in df.collect()), key=lambda r: r[0])


def test_token_files_split_one_id_and_keep_all_ids(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = hot(spark, 600)
    named = docs.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))))
    for table in (docs, named, docs.withColumn("doc_id", F.col("doc_id").cast("int"))):
        folder = tokenfile.new_path(spark, "files")
        if table.schema["doc_id"].dataType.simpleString() == "bigint":
            files = tokenfile.write_files(table, folder, part_bytes=500)
            assert files.agg(F.max("n_docs")).first()[0] < 200 and files.count() > 5
        out = tokenfile.round_trip(table)
        assert out.schema["doc_id"].dataType == table.schema["doc_id"].dataType
        got = rows_in_order(out)
        ids = [r[3] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0 if not isinstance(i, str) else i))
        assert [r[0] for r in got] == np.cumsum([0, *[r[1] for r in got]])[:-1].tolist()
        want = [(r["doc_id"], np.array([*library.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")) for r in table.collect()]
        assert sorted(((str(i), len(x), zlib.crc32(x.tobytes())) for i, x in want)) == sorted((str(r[3]), r[1], r[2]) for r in got)


def test_a_label_of_a_repeated_id_brings_one_row(spark):
    docs = hot(spark, 400).withColumn("text", F.concat("text", F.lit(" and more")))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 400, 2)] + [(7, 1)], "doc_id long, quality int")
    got = classifier.score(docs, labels)
    assert got.count() == 400 and got.filter("score is null or score < 0 or score > 1").count() == 0
