"""Claims are made once for their check, and checked once for their audit."""

from seriesmill.operators import claims


def test_claims_are_not_made_anew(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    schema = "query_id long, place int, sentence string, cited array<long>, numbers array<double>, dates array<string>"
    told = spark.createDataFrame([(1, 1, "It was 5.5 [7].", [7], [5.5], []), (1, 2, "It was 9.5 [7].", [7], [9.5], []), (2, 1, "Nothing.", [], [], [])], schema).mapInPandas(seen, schema)
    selected = spark.createDataFrame([(1, "current", 7, 5.5), (1, "current", 8, 6.5), (2, "current", 9, 1.0)], "query_id long, mode string, evidence_id long, value double").selectExpr(
        "*", "timestamp'2020-01-01 00:00:00' as ts", "cast(null as string) as role", "true as is_primary")
    verified = claims.verify_claims(told, selected, claims.derived_facts(selected))
    got = {r["query_id"]: (r["claims"], r["grounded"], r["utilisation"]) for r in claims.audit(verified, selected).collect()}
    assert got == {1: (2, 1, 0.5), 2: (1, 0, 0.0)}
    assert runs.value == 3
