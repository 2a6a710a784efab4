"""Sources on small files, and streams against their batch twins after draining."""

import pytest
from pyspark.sql import functions as F

from seriesmill.operators import series
from seriesmill.sources import tables
from seriesmill.streaming import jobs


def test_observations_csv(spark, tmp_path):
    (tmp_path / "o.csv").write_text("date,Patient,CODE,Description,VALUE,UNITS\n2024-01-02T03:04:05Z,p1,c1,Glucose,5.5,mmol/L\n2024-13-02,p1,c2,Urine,positive,\n,p2,c1,Glucose,<5,mmol/L\n")
    got = tables.read_observations_csv(spark, str(tmp_path / "o.csv")).orderBy("analyte_raw", "source_patient_id").collect()
    assert [(r["source_patient_id"], r["value_numeric"], r["value_text"]) for r in got] == [("p1", 5.5, None), ("p2", None, "<5"), ("p1", None, "positive")]
    assert got[0]["observation_ts"].hour == 3 and got[1]["observation_ts"] is None and got[2]["observation_ts"] is None
    (tmp_path / "bad.csv").write_text("DATE,PATIENT\n1,2\n")
    with pytest.raises(ValueError, match="DESCRIPTION"):
        tables.read_observations_csv(spark, str(tmp_path / "bad.csv"))


def test_labevents_csv_falls_back_on_the_item_id(spark, tmp_path):
    (tmp_path / "e.csv").write_text("labevent_id,subject_id,itemid,charttime,valuenum,value\n1,10,50,2024-01-01 10:00:00,4.2,4.2\n2,10,51,2024-01-02 10:00:00,,neg\n")
    (tmp_path / "i.csv").write_text("itemid,label\n50,Sodium\n")
    got = tables.read_labevents_csv(spark, str(tmp_path / "e.csv"), str(tmp_path / "i.csv")).orderBy("observation_ts").collect()
    assert [(r["analyte_raw"], r["value_numeric"], r["value_text"]) for r in got] == [("Sodium", 4.2, None), ("ITEM_51", None, "neg")]


def test_jsonl_defaults_and_knowledge_text(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "a", "unit": "g"}\n{"id": "b"}\n')
    got = tables.read_records_jsonl(spark, str(tmp_path / "r.jsonl"), "id string, unit string", {"unit": "none"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "g"), ("b", "none")]
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "x.txt").write_text("SOURCE: me\nLICENCE: open\nURL: u\n---\nbody text")
    row = tables.read_knowledge_text(spark, str(tmp_path / "kb")).first()
    assert (row["source"], row["licence"], row["url"], row["text"]) == ("me", "open", "u", "body text")


def test_ingest_splits_patients_without_overlap(spark, tmp_path):
    lines = ["DATE,PATIENT,CODE,DESCRIPTION,VALUE"] + [f"2024-01-{d:02d},p{p},c,Glucose,{p}.{d}" for p in range(10) for d in range(1, 4)]
    (tmp_path / "o.csv").write_text("\n".join(lines))
    out = tables.ingest_cohort(spark, str(tmp_path / "o.csv"), str(tmp_path / "out"))
    assert {r["split"]: (r["patients"], r["records"]) for r in out["counts"].collect()} == {"train": (6, 18), "dev": (2, 6), "test": (2, 6)}
    assert out["audit"].first()["n_patients"] == 10
    tables.append_values(out["observations"], str(tmp_path / "more"), "ts")
    tables.save_run(str(tmp_path / "runs"), "r1", counts=out["counts"])
    assert spark.read.parquet(str(tmp_path / "more")).count() == 30 and spark.read.json(str(tmp_path / "runs/counts")).count() == 3


def events(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", "x@y") for m in (0, 1, 2, 3, 14, 15, 16, 40)] + [("b", "2024-01-01 00:05:00", "hi"), ("b", "2024-01-01 00:05:00", "hi")]
    df = spark.createDataFrame(rows, "k string, s string, text string").select("k", F.to_timestamp("s").alias("ts"), "text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_rate_alerts_reset_at_the_first_row_after_expiry(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    batch = sorted(tuple(r) for r in jobs.rate_alerts(df, "k", "ts", 900, 4).collect())
    assert [(r[2], r[4]) for r in batch if r[0] == "a"] == [(1, False), (2, False), (3, False), (4, False), (5, True), (1, False), (2, False), (1, False)]
    jobs.drain(jobs.rate_alerts_stream(stream, "k", "ts", 900, 4), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch


def test_replays_go_and_rules_and_windows_hold(spark, tmp_path):
    df, stream = events(spark, tmp_path)
    jobs.drain(jobs.timeline(stream, "ts", ["k", "ts", "text"]), str(tmp_path / "t"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 9
    rules = [(1, "contact", "@")]
    jobs.drain(jobs.rule_stream(stream, ["k", "ts"], "text", rules), str(tmp_path / "r"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "r")).filter("category = 'contact'").count() == 8
    jobs.drain(jobs.activity_windows(stream, "ts", "k", "10 minutes", "1 minute"), str(tmp_path / "w"), str(tmp_path / "c3"))
    got = {(r["start"].minute, r["k"]): r["n"] for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got[0, "a"] == 4 and got[0, "b"] == 2 and got[10, "a"] == 3
    assert jobs.gaps(df, "k", "ts", 600).filter("k = 'a'").agg(F.max("session")).first()[0] == 3


def test_a_key_without_pauses_and_one_with_many(spark):
    """Pieces fold as the whole does, in a loop by hand."""
    import random

    rng = random.Random(3)
    times = {"busy": [rng.randint(0, 20_000) for _ in range(3000)], "calm": [rng.randint(0, 4_000_000) for _ in range(300)], None: [5, 5, 5], "one": [7]}
    df = spark.createDataFrame([(k, x) for k, own in times.items() for x in own], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).repartition(5)
    got = sorted(((r["key"] or "", r["us"], r["n"], r["begun_us"], r["alert"], r["retry_after"]) for r in jobs.rate_alerts(df, "k", "ts", 900, 4).collect()))
    want = []
    for k, own in times.items():
        begun, n = None, 0
        for x in sorted(own):
            if begun is None or x - begun >= 900:
                begun, n = x, 0
            n += 1
            want.append((k or "", x * 10**6, n, begun * 10**6, n > 4, max(1, begun + 900 - x) if n > 4 else None))
    assert got == sorted(want)


def test_login_alerts_have_two_scopes_and_opaque_keys(spark):
    rows = [("10.0.0.1", f" User{i % 3}@x.y ".upper() if i % 2 else f"user{i % 3}@x.y", i) for i in range(70)]
    df = spark.createDataFrame(rows, "ip string, mail string, s long").select("ip", "mail", F.timestamp_seconds("s").alias("ts"))
    got = jobs.login_alerts(df, "ip", "mail", "ts", b"secret").collect()
    alerts = {s: sum(r["alert"] for r in got if r["scope"] == s) for s in ("source", "source_email")}
    assert alerts == {"source": 10, "source_email": 70 - 3 * 8}
    assert len({r["key"] for r in got}) == 4 and all(len(r["key"]) == 64 for r in got)
    assert [r["retry_after"] for r in got if r["scope"] == "source" and r["us"] == 69 * 10**6] == [831]


def test_monitor_takes_late_readings_in_order(spark, tmp_path):
    """Batch by batch, with readings up to an hour late: what is said last is what the batch form says of all rows."""
    import random

    rng, rows = random.Random(8), []
    for s in range(6):
        level = 100.0
        for j in range(90):
            level += rng.gauss(0, 1) + (6 if s == 1 and j > 60 else 0)
            rows.append((f"p{s}", "x", 600 * j + s, round(rng.choice([level, 50.0]) if s == 2 else 7.0 if s == 3 else level, 3), 1000 * s + j))
    rows += [("few", "x", 10, 1.0, 1), ("few", "x", 400, 2.0, 2), ("tie", "x", 5, 1.0, 3), ("tie", "x", 5, 3.0, 4), ("tie", "x", 5, 2.0, 5), ("p0", "x", 777, None, 6)]
    rows.sort(key=lambda r: r[2] + rng.randint(0, 3000))  # as they arrive
    schema = "patient_id string, analyte string, s long, value double, evidence_id long"
    for b in range(9):
        part = rows[b * len(rows) // 9 : (b + 1) * len(rows) // 9]
        spark.createDataFrame(part, schema).select("patient_id", "analyte", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "value", "evidence_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    everything = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.drain(jobs.monitor_stream(stream, late="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    said = spark.read.parquet(str(tmp_path / "out"))
    assert said.count() > 30  # said anew with each batch
    show = lambda df: sorted((r["patient_id"], r["n"], r["alarm"], r["score"], r["method"], r["causal_z"], r["pct_delta"], r["cusum_alarm"], r["triggers"]) for r in df.collect())
    got, want = show(jobs.last_word(said)), show(series.monitor(everything))
    assert len(want) == 8
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4), (a, b)


def test_hull_answers_as_all_points_do():
    import random

    rng = random.Random(2)
    for sign in (1.0, -1.0):
        hull, p, points = jobs.Hull(sign), 0.0, []
        for i in range(1, 400):
            p += rng.gauss(0, 1)
            points.append((i, p))
            hull.add(i, p)
            c = rng.gauss(0, 0.3)
            assert hull.least(c) == pytest.approx(min(sign * (y - c * x) for x, y in points))
        assert len(hull.points) < 60 and jobs.Hull(sign, hull.packed()).points == hull.points
