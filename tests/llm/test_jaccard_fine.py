"""op6: which pairs come to the texts, and how often keys are counted."""

import random

from pyspark.sql import functions as F

from seriesmill.llm import common, jaccard, skew


def long_texts():
    """Pairs of long texts that share six of ten passages, and one pair of near copies."""
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(6):
        head = make(4200)
        rows += [(2 * k, " ".join(head + make(2800))), (2 * k + 1, " ".join(head + make(2800)))]
    near = make(7000)
    return [*rows, (100, " ".join(near)), (101, " ".join(near[:-20] + make(20)))]


def test_texts_of_pairs_that_cannot_link_are_not_shuffled(spark, monkeypatch):
    """Before, counts in 128 groups let all these pairs through, and both texts of each were shuffled."""
    held = {}

    def settle(df, label, **options):
        out = common.settle(df, label, **options)
        if label in ("wide-pairs", "pairs"):
            held[label] = held.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "settle", settle)
    got = {r.doc_id: r.component_id for r in jaccard.link(spark.createDataFrame(long_texts(), "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(12)} | {100: 100, 101: 100}
    assert held["pairs"] <= 2 and held.get("wide-pairs", 7) > 2  # the near copies, and at most one other


def test_known_counts_deal_as_counted_ones_do(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = common.settle(left.groupBy("k").agg(F.count(F.lit(1)).alias("rows_")), "counts")
    want, got = (sorted(map(tuple, skew.salted(left, right, "k", "v", keep=True, counts=c).collect())) for c in (None, counts))
    assert want == got and len(got) == 3000 and max(r[-1] for r in got) > 1
