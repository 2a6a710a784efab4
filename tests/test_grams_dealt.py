"""Character grams are counted where their text is: rows of (text, gram) aren't shuffled."""

from seriesmill.operators import retrieval


def test_counts_stay_with_their_text(spark):
    rows = [(1, "The cat the"), (2, "cat"), (3, None), (4, ""), (5, "dog\tdog é")]
    df = retrieval.gram_tfidf(spark.createDataFrame(rows, "k long, text string").repartition(3), ["k"], most=6)
    assert "hashpartitioning(k#" in (plan := df._jdf.queryExecution().executedPlan().toString())
    assert not any("hashpartitioning(k#" in line and "gram#" in line.split("hashpartitioning(")[1] for line in plan.splitlines())
    got = {}
    for r in df.collect():
        got.setdefault(r["k"], {})[r["gram"]] = r["weight"]
    assert set(got) <= {1, 2, 5} and len({g for own in got.values() for g in own}) == 6
    assert all(abs(sum(w * w for w in own.values()) - 1) < 1e-5 for own in got.values())
