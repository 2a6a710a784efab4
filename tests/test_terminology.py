"""Measures brought to a vocabulary, and both forms of ingest."""

import pytest

from seriesmill.operators import terminology
from seriesmill.sources import tables

WORDS = [("Haemoglobin", "718-7", "g/dL", ["Hb", "hemoglobin [mass/volume] in blood"]), ("Glucose", "2345-7", "mg/dL", ["blood sugar"]), ("Zinc", None, None, None)]
ROWS = [
    ("718-7", "whatever", None, "Haemoglobin", "exact_code", "g/dL", "718-7"), (" 718-7 ", "x", "", "Haemoglobin", "exact_code", "g/dL", "718-7"), (None, " HB ", "g/L", "Haemoglobin", "alias", "g/L", "718-7"),
    ("9", "Hemoglobin  [Mass/volume] in Blood", None, "Haemoglobin", "alias", "g/dL", "718-7"), ("9", "Glucose (fasting)", None, "Glucose", "alias", "mg/dL", "2345-7"), (None, "Test 4 (blood sugar)", None, "Glucose", "alias", "mg/dL", "2345-7"),
    (None, "blood [sugar]", None, "Glucose", "alias", "mg/dL", "2345-7"), (None, "zinc", None, "Zinc", "alias", None, None), (None, "Iron", "ug", None, "unmapped", "ug", None), (None, None, None, None, "unmapped", None, None), ("", "", None, None, "unmapped", None, None),
]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(WORDS, terminology.VOCABULARY)


def test_code_then_name(spark, words):
    rows = [(i, *r[:3]) for i, r in enumerate(ROWS)] * 2
    got = terminology.map_measures(spark.createDataFrame(rows, "i long, code string, analyte_raw string, unit string").repartition(3), words).collect()
    assert len(got) == 2 * len(ROWS)
    for r in got:
        assert (r["analyte_canonical"], r["mapping_status"], r["unit"], r["loinc_code"]) == ROWS[r["i"]][3:], ROWS[r["i"]]
        assert r["concept_id"] == (f"LOINC:{r['loinc_code']}" if r["loinc_code"] else None)


def test_ingest_of_observations(spark, words, tmp_path):
    lines = ["DATE,PATIENT,CODE,DESCRIPTION,VALUE,UNITS"] + [f"2024-01-{d:02d},p{p},{c},{name},{p}.{d}," for p in range(10) for d in range(1, 4) for c, name in (("718-7", "x"), ("", "Blood Sugar"), ("", "Odd"))]
    (tmp_path / "o.csv").write_text("\n".join(lines))
    out = tables.ingest_cohort(spark, str(tmp_path / "o.csv"), str(tmp_path / "out"), vocabulary=words, per_intent=5)
    assert {r["split"]: (r["patients"], r["records"], r["mapped"]) for r in out["summary"].collect()} == {"train": (6, 54, 36), "dev": (2, 18, 12), "test": (2, 18, 12)}
    assert {r["analyte"] for r in out["observations"].select("analyte").distinct().collect()} == {"Haemoglobin", "Glucose", "Odd"}
    assert out["queries"].groupBy("intent").count().collect() and all(r["count"] == 5 for r in out["queries"].groupBy("intent").count().collect())
    assert sum(r["queries"] for r in out["summary"].collect()) == out["queries"].count()
    splits = {r["patient_id"]: r["split"] for r in out["observations"].select("patient_id", "split").distinct().collect()}
    assert all(splits[r["patient_id"]] == r["split"] for r in out["queries"].collect())


def test_ingest_of_lab_events(spark, words, tmp_path):
    (tmp_path / "e.csv").write_text("labevent_id,subject_id,itemid,charttime,valuenum,value,valueuom,flag\n" + "\n".join(f"{i},s{i % 5},{50 + i % 2},2024-02-{i % 9 + 1:02d} 08:00:00,{i},{i},,{'abnormal' if i % 7 == 0 else ''}" for i in range(40)))
    (tmp_path / "d.csv").write_text("itemid,label,loinc_code\n50,Sugar,2345-7\n51,Unknown thing,\n")
    out = tables.ingest_cohort(spark, str(tmp_path / "e.csv"), str(tmp_path / "out"), items=str(tmp_path / "d.csv"), vocabulary=words)
    assert out["observations"].count() == 40 and out["observations"].filter("analyte = 'Glucose' and unit = 'mg/dL'").count() == 20
    assert out["queries"].filter("intent = 'abnormal'").count() > 0 and out["audit"].first()["n_patients"] == 5
