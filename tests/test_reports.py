"""Reports read from their text: rows, named tests, dates, medicines."""

import datetime

import pytest
from pyspark.sql import functions as F

from seriesmill.functions import scalar
from seriesmill.operators import reports

TABLE = """
COMPLETE BLOOD COUNT (CBC)
=========================================
TEST NAME           RESULT    UNIT    REFERENCE RANGE
-----------------------------------------
Haemoglobin         12.5      g/dL    (13.0 - 17.0)
WBC                 8500      /cumm   (4500 - 11000)
RBC                 4.2       mill/cumm (4.5 - 5.5)
Platelets           180000    /cumm   (150000 - 400000)
Hematocrit          38.0      %       (40.0 - 50.0)
MCV                 88.0      fL      (80.0 - 100.0)  H
Triglycerides       185       mg/dL   (< 150)
TSH                 6,8       µIU/mL  0.4 to 4.0  LOW

Tablet              as needed
Printed on 12/05/2024 at 10:30
"""
PLAIN = "Glucose: 110 mg/dL (70 - 110) H\nSodium = 140 mmol/L\nRef: 12/05/2024\nTest : 5\nTablet 5 mg\nNa | 141\nK | 4.1 | mmol/L | 3.5-5.1\nCreatinine\t0.9\tmg/dL\nReport Date: 11/05/2024\nWeight 70 kg\nUrea: about 30\n"
BARS = "Test | Result | Unit | Reference\n--- | --- | --- | ---\nSodium | 141 | mmol/L | 135-145\nPotassium | 4,1 | mmol/L |\n | 7 |\nChloride | high |\n"
TURNED = "Investigation   Unit   Normal Range   Value\nUric acid   mg/dL   3.4 - 7.0   8.1\nIron   ug/dL   59\n\nParameter\tValue\tUnits\nFerritin\t22\tng/mL\n"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("id", *[c for c in ("line_no", "place") if c in df.columns]).select(*columns).collect()]


def test_rows_below_a_header_of_columns(spark):
    got = rows(reports.lab_lines(frame(spark, TABLE), "id", "text"), "line_no", "name", "value", "unit", "ref_low", "ref_high", "flag", "confidence")
    assert got == [
        (6, "Haemoglobin", 12.5, "g/dL", 13.0, 17.0, None, 0.95), (7, "WBC", 8500.0, "/cumm", 4500.0, 11000.0, None, 0.95), (8, "RBC", 4.2, "mill/cumm", 4.5, 5.5, None, 0.95),
        (9, "Platelets", 180000.0, "/cumm", 150000.0, 400000.0, None, 0.95), (10, "Hematocrit", 38.0, "%", 40.0, 50.0, None, 0.95), (11, "MCV", 88.0, "fL", 80.0, 100.0, "high", 0.95),
        (12, "Triglycerides", 185.0, "mg/dL", None, None, None, 0.8), (13, "TSH", 6.8, "µIU/mL", 0.4, 4.0, "low", 0.95),
    ]


def test_plain_rows_keep_rows_with_more_bars_out(spark):
    got = rows(reports.lab_lines(frame(spark, PLAIN), "id", "text"), "line_no", "name", "value", "unit", "ref_low", "ref_high", "flag")
    assert got == [(1, "Glucose", 110.0, "mg/dL", 70.0, 110.0, "high"), (2, "Sodium", 140.0, "mmol/L", None, None, None), (6, "Na", 141.0, None, None, None, None), (8, "Creatinine", 0.9, "mg/dL", None, None, None)]


def test_tables_of_bars_where_nothing_else_counts(spark):
    got = rows(reports.lab_lines(frame(spark, BARS), "id", "text"), "line_no", "name", "value", "unit", "ref_low", "ref_high")
    assert got == [(3, "Sodium", 141.0, "mmol/L", 135.0, 145.0), (4, "Potassium", 4.1, "mmol/L", None, None)]


def test_the_header_says_which_column_is_which(spark):
    got = rows(reports.lab_lines(frame(spark, TURNED), "id", "text"), "line_no", "name", "value", "unit", "ref_low", "ref_high")
    assert got == [(2, "Uric acid", 8.1, "mg/dL", 3.4, 7.0), (6, "Ferritin", 22.0, "ng/mL", None, None)]


@pytest.mark.parametrize("text", [None, "", "\n\n", "Tablet 5 mg\nonce daily", "Haemoglobin         12.5      g/dL", "Date: 2024-05-18", "Time: 10:30", "Ratio: 3-4", "Complete blood count: 5", "x: 5", "5: 5"])
def test_lines_that_are_no_results(spark, text):
    assert reports.lab_lines(frame(spark, text), "id", "text").count() == 0


def test_first_row_of_each_name(spark):
    got = reports.first_of_each(reports.lab_lines(frame(spark, "Na: 1\nUrea: 2\nNA: 3", "na: 4"), "id", "text"), "id")
    assert sorted((r["id"], r["line_no"], r["name"], r["value"]) for r in got.collect()) == [(0, 1, "Na", 1.0), (0, 2, "Urea", 2.0), (1, 1, "na", 4.0)]


def test_long_report(spark):
    text = "Test  Result  Unit\n" + "\n".join(f"Marker {chr(97 + i % 26)}  {i}  mg/dL" for i in range(3000))
    got = reports.lab_lines(frame(spark, text), "id", "text").agg(F.count("*"), F.sum("value")).first()
    assert tuple(got) == (3000, 4498500.0)


# --- named tests ---
def values(spark, *texts):
    return {(r["id"], r["test"]): r for r in reports.lab_values(frame(spark, *texts), "id", "text").collect()}


def test_named_tests_with_their_bounds(spark):
    got = values(spark, TABLE, "Hb. 9,5 g/dl\nHaemoglobin (Hb): 12.5 g/dL\nThb 3 rbc 5", "DIABETES PANEL\nHbA1c               6.8       %       (< 5.7)", None)
    one = got[0, "Haemoglobin"]
    assert (one["panel"], one["value"], one["unit"], one["ref_low"], one["ref_high"]) == ("CBC", 12.5, "g/dL", 13.0, 17.0)
    assert (got[0, "WBC"]["value"], got[0, "WBC"]["unit"], got[0, "WBC"]["ref_high"]) == (8500.0, "/cumm", 11000.0)
    assert (got[0, "TSH"]["value"], got[0, "TSH"]["panel"]) == (6.8, "Thyroid")
    assert (got[0, "Triglycerides"]["value"], got[0, "Triglycerides"]["ref_low"]) == (185.0, None)
    assert (got[1, "Haemoglobin"]["value"], got[1, "Haemoglobin"]["unit"]) == (9.5, "g/dl")  # the first place
    assert got[1, "RBC"]["value"] == 5.0
    assert (got[2, "HbA1c"]["value"], got[2, "HbA1c"]["unit"], got[2, "HbA1c"]["panel"]) == (6.8, "%", "HbA1c")
    assert len(got) == len(set(got)) and (3, "WBC") not in got


def test_a_line_s_own_date_goes_before_the_document_s(spark):
    got = values(spark, "Sample Collection Date: 18/05/2024\nHaemoglobin: 13.5 g/dL\nWBC: 7000 /cumm tested on 20/05/2024", "TSH: 2.1")
    show = lambda r: (str(r["date"]), r["date_kind"], r["date_confidence"])
    assert show(got[0, "Haemoglobin"]) == ("2024-05-18", "collection", 0.95)
    assert show(got[0, "WBC"]) == ("2024-05-20", "test", 0.9)
    assert got[1, "TSH"]["date"] is None and got[1, "TSH"]["date_kind"] is None


# --- dates ---
D = datetime.date


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-05-18", D(2024, 5, 18)), ("2024/05/18", D(2024, 5, 18)), ("18/05/2024", D(2024, 5, 18)), ("03/09/2023", D(2023, 9, 3)), ("18-05-2024", D(2024, 5, 18)), ("05/18/2024", D(2024, 5, 18)),
        ("18 May 2024", D(2024, 5, 18)), ("18-May-2024", D(2024, 5, 18)), ("18/May/2024", D(2024, 5, 18)), ("18-JAN-2024", D(2024, 1, 18)), ("18 January 2024", D(2024, 1, 18)), ("Oct 05, 2023", D(2023, 10, 5)),
        ("September 12, 2022", D(2022, 9, 12)), ("Sept 1 2022", D(2022, 9, 1)), ("2024 May 18", D(2024, 5, 18)), ("2024-Jan-15", D(2024, 1, 15)), ("1.2.49", D(2049, 2, 1)), ("1.2.50", D(1950, 2, 1)),
        ("2024-05-18T10:00", D(2024, 5, 18)), ("31/02/2024", None), ("13/13/2024", None), ("01/01/1899", None), ("2024-13-01", None), ("12 Foo 2024", None), ("", None), (None, None), ("12", None),
    ],
)
def test_one_date(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(scalar.parse_date_any(F.col("s"))).first()[0] == want


def kinds(spark, text):
    return rows(reports.dates(frame(spark, text), "id", "text"), "line_no", "place", "date", "kind")


def test_kinds_by_the_label_before(spark):
    text = "LAB\nRegistration Date: 10/05/2024\n  Sample Collection Date: 11/05/2024\nDate of Test - 12.05.24\nResult Date 13-May-2024\nReport Date: May 14, 2024; DOB: 01/02/1960\nBilling Date: 15/05/2024\nseen 16/05/2024 (bill date later)\nCollected on 17/05/2024, reported on 18/05/2024 and 19/05/2024"
    assert kinds(spark, text) == [
        (2, 1, D(2024, 5, 10), "administrative"), (3, 1, D(2024, 5, 11), "collection"), (4, 1, D(2024, 5, 12), "test"), (5, 1, D(2024, 5, 13), "result"), (6, 1, D(2024, 5, 14), "report"),
        (6, 2, D(1960, 2, 1), "administrative"), (7, 1, D(2024, 5, 15), "administrative"), (8, 1, D(2024, 5, 16), "administrative"), (9, 1, D(2024, 5, 17), "collection"), (9, 2, D(2024, 5, 18), "report"),
        (9, 3, D(2024, 5, 19), "unlabelled"),
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Collection Date: 11/05/2024\nReport Date: 14/05/2024", (D(2024, 5, 11), "collection", 0.95)),
        ("Report Date: 14/05/2024\nDate of Test: 12/05/2024", (D(2024, 5, 12), "test", 0.9)),
        ("Printed on 3 Mar 2024\n1/1/2024", (D(2024, 3, 3), "report", 0.75)),
        ("seen 2/1/2024\nand 1/1/2024", (D(2024, 1, 2), "unlabelled", 0.5)),
        ("Registration Date: 10/05/2024\nBill Date: 11/05/2024", None),
        ("Collection Date: 31/02/2024", None), ("no dates", None), (None, None),
    ],
)
def test_the_date_that_speaks_for_a_document(spark, text, want):
    got = rows(reports.document_date(frame(spark, text), "id", "text"), "date", "kind", "confidence")
    assert got == ([want] if want else [])


# --- medicines ---
def medicines(spark, text):
    return rows(reports.medicine_lines(frame(spark, text), "id", "text"), "line_no", "name", "schedule", "evidence")


def test_medicines_and_their_instructions(spark):
    text = "Patient: Made Up\n1. Alphamed 250 mg tablet\n\nInstruction: one daily for 5 days\nReported reaction: Betamed 10 mg tablet - rash\nMedicine: Gammamed 5 ml\n \n\nSig: at night\n2) Deltamed 7 mg\nMaybe more?\nInstruction: not adjacent"
    assert medicines(spark, text) == [
        (2, "Alphamed 250 mg tablet", "one daily for 5 days", "1. Alphamed 250 mg tablet\n\nInstruction: one daily for 5 days"), (6, "Gammamed 5 ml", "at night", "Medicine: Gammamed 5 ml\n \n\nSig: at night"),
        (10, "Deltamed 7 mg", "", "2) Deltamed 7 mg"),
    ]


@pytest.mark.parametrize("text", [None, "", "Glucose 100 mg/dL\nStop Alphamed 10 mg tablet\nPrevious: Alphamed 5 mg tablet", "Alphamed 10 mg", "Tablet of stone", "Allergies: 5 mg tablet", "1. " + "x" * 400 + " 5 mg tablet", "Instruction: 5 mg tablet"])
def test_lines_that_are_no_medicines(spark, text):
    assert medicines(spark, text) == []


def test_reach_length_and_number_of_medicines(spark):
    far = "1. A 5 mg\n\n\n\n\nInstruction: too far\n2. B 5 mg\n\n\n\nInstruction: near\n3. C 5 mg\nDose: " + "y" * 201
    assert [m[2] for m in medicines(spark, far)] == ["", "near", ""]
    many = medicines(spark, "\n".join(f"{i}. M{i} 5 mg" for i in range(1, 50)))
    assert [m[0] for m in many] == list(range(1, 31))
    twice = medicines(spark, "1. A 10 mg tablet\n\n2. A 10 mg tablet\nInstruction: of the second")
    assert [m[2] for m in twice] == ["", "of the second"]
