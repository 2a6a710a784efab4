"""What a report's text says: rows of results, named tests, dates, medicines. All by built-in expressions.

A document stays one row while its lines are read together: what one line says about others (the header above a table, a table that
counts only where no plain row stands, the instruction below a medicine) is looked up in the array of its lines, so
nothing is shuffled and only the finished rows are spread out. Lines count from 1.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar

_NUM = r"[-+]?\d+(?:[.,]\d+)?"
_FLAG = r"HIGH|LOW|H|L|\*"
#: A unit has a letter, a per cent sign or a slash first, perhaps behind a power of ten, and isn't a flag at the line's end.
_UNIT = rf"(?!(?:{_FLAG})\s*$)(?:10\^\d+)?[A-Za-zµμ%²³^/][A-Za-z0-9µμ%²³^./*-]*"
_RANGE = rf"[(\[]?\s*(?:({_NUM})\s*(?:-|–|to)\s*({_NUM})|[<>≤≥]=?\s*{_NUM})\s*[)\]]?"
#: value (no date, time or span), unit, range, flag, and nothing else.
_TAIL = rf"({_NUM})(?![/.:,-]?\d)(?:\s*({_UNIT}))?(?:\s*{_RANGE})?(?:\s*({_FLAG}))?\s*$"
#: A name of two characters and more, and its separator, which isn't that of hours and minutes.
_NAMED = r"(?i)^\s*([A-Za-z][A-Za-z0-9()/%.+\- ]{1,60}?)\s*(?!(?<=\s\d{1,2}):\d\d(?:\s|$))[:|=\t]\s*"

#: Words of header cells and what they stand for: fixed values.
HEADERS = {
    "test": "name", "test name": "name", "parameter": "name", "investigation": "name", "analyte": "name", "result": "value", "results": "value", "value": "value", "observed value": "value", "unit": "unit",
    "units": "unit", "reference": "range", "ref range": "range", "normal range": "range", "reference range": "range", "flag": "flag",
}


def _struct(**fields: Column) -> Column:
    """With names that stay in nested functions of arrays too."""
    return F.named_struct(*(x for name, field in fields.items() for x in (F.lit(name), field)))


def split_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[​‌‍﻿]", ""), r"\r\n|[\n\r]")


def _lookup(table: dict[str, str], cell: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.lower(F.trim(cell)))


def _cells(line: Column) -> Column:
    """Cells between bars, else between tabs or two blanks and more."""
    cut = F.when(F.contains(line, F.lit("|")), F.split(line, r"\|")).otherwise(F.split(F.trim(line), r"\t+| {2,}"))
    return F.filter(F.transform(cut, lambda c: F.trim(c)), lambda c: c != "")


def _number(s: Column) -> Column:
    return scalar.parse_number(s).cast("double")


# --- result rows ---
def lab_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Every line shaped like a result: key, line_no, name, value, unit, ref_low, ref_high, flag (high, low), confidence.

    A plain row is a name, a separator (: | = or a tab) and a value, then perhaps a unit, a range and a flag. A row of columns counts
    below a header, whose words say which column is which, until the next header; a row with more bars counts
    where the document has no plain row. Header rows, dates and lines with other words at their end are no results."""
    lines = F.transform(split_lines(F.col(text)), lambda line, i: _struct(line_no=i + 1, line=line, cells=_cells(line)))
    lines = F.transform(lines, lambda x: x.withField("roles", F.transform(x["cells"], lambda c: _lookup(HEADERS, c))))
    known = lambda roles: F.size(F.filter(roles, lambda r: r.isNotNull()))
    # the first word of a header may stand alone in a sentence: two known cells make one
    head = lambda x: (known(x["roles"]) >= 2) & ~x["line"].rlike(r"\d")

    def read(x: Column) -> Column:
        """name and tail of a line; null where it is shaped like no row."""
        cells, above = x["cells"], x["above"]
        barred, wide = F.contains(x["line"], F.lit("|")), F.size(cells) >= 2
        place = lambda role: F.array_position(above, F.lit(role)).cast("int")
        cell = lambda role: F.when(place(role) > 0, F.try_element_at(cells, place(role)))
        whole = F.coalesce(F.size(cells) == F.size(above), F.lit(False)) & (place("name") > 0) & (place("value") > 0)
        first_name = above.isNull() | (place("name") == 1)
        by_columns = wide & (barred & ~x["plain"] | ~barred & above.isNotNull())
        rest = F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), " ")
        named = _struct(name=F.regexp_extract(x["line"], _NAMED, 1), tail=F.regexp_replace(x["line"], _NAMED, ""))
        columns = _struct(name=cell("name"), tail=F.concat_ws(" ", cell("value"), cell("unit"), cell("range"), cell("flag")))
        first = _struct(name=F.element_at(cells, 1), tail=rest)
        return F.when(x["line"].rlike(_NAMED + _TAIL), named).when(by_columns & whole, columns).when(by_columns & first_name, first)

    def row(x: Column, r: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.trim(r["name"]), r"\s+", " "), r"^[|:-]+|[|:-]+$", "")
        return F.when(r["tail"].rlike("(?i)^" + _TAIL), _struct(line_no=x["line_no"], line=x["line"], name=clean, tail=r["tail"]))

    def of_lines(lines: Column) -> Column:
        plain = F.exists(lines, lambda x: x["line"].rlike(_NAMED + _TAIL) & _lookup(HEADERS, F.regexp_extract(x["line"], _NAMED, 1)).isNull())
        heads = F.transform(F.filter(lines, head), lambda x: _struct(line_no=x["line_no"], roles=x["roles"]))
        above = lambda d, x: F.try_element_at(F.filter(d["heads"], lambda h: h["line_no"] < x["line_no"]), F.lit(-1))["roles"]
        one = lambda d, x: scalar.let(_struct(line_no=x["line_no"], line=x["line"], cells=x["cells"], plain=d["plain"], above=above(d, x)), lambda y: scalar.let(read(y), lambda r: row(y, r)))
        return scalar.let(_struct(plain=plain, heads=heads), lambda d: F.transform(F.filter(lines, lambda x: x["line"].rlike(r"\d")), lambda x: one(d, x)))

    # each step is evaluated once, for the document or for its line; only the rows are spread out
    rows = df.select(key, F.inline(F.array_compact(scalar.let(lines, of_lines)))).filter(F.col("name").rlike("[A-Za-z]"))
    rows = rows.filter(_lookup(HEADERS, F.col("name")).isNull() & ~F.startswith(F.lower("name"), F.lit("complete blood")))
    part = lambda i: F.nullif(F.regexp_extract("tail", "(?i)^" + _TAIL, i), F.lit(""))
    flag = F.element_at(F.create_map(*map(F.lit, ("H", "high", "HIGH", "high", "L", "low", "LOW", "low"))), F.upper(part(5)))
    ranged = F.when(part(4).isNotNull(), part(3))
    return rows.select(
        key, "line_no", "name", _number(part(1)).alias("value"), part(2).alias("unit"), _number(part(3)).alias("ref_low"), _number(part(4)).alias("ref_high"), flag.alias("flag"),
        scalar.extraction_confidence(F.col("line"), part(2), ranged).alias("confidence"),
    )


def first_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one name (whatever its case) in a document the first."""
    others = [c for c in rows.columns if c not in (key, "line_no")]
    first = rows.groupBy(key, F.lower("name").alias("name_")).agg(F.min_by(F.struct(*others), "line_no").alias("r"), F.min("line_no").alias("line_no"))
    return first.select(key, "line_no", "r.*")


# --- dates ---
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DATE = (
    r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2,3})" + rf"|\d{{1,2}}[-/.\s]+{_MONTH}[-/.,\s]+(?:\d{{4}}|\d{{2,3}})" + rf"|{_MONTH}[-/.\s]+\d{{1,2}}[-/.,\s]+(?:\d{{4}}|\d{{2,3}})"
    rf"|\d{{4}}[-/.\s]+{_MONTH}[-/.,\s]+\d{{1,2}})"
)
#: A date, and what stands between the dates of a line with each: from where the last one ended, or the rest of a long line would be
#: searched anew from each of its places.
_ANY_DATE, _AROUND = rf"(?i)\b{_DATE}\b", rf"(?i)\G(.*?)\b({_DATE})\b"
#: Labels before a date, by kind: fixed values. A full stop may be left out.
DATE_LABELS = {
    "collection": ("sample collection date", "specimen collection date", "collection date", "date of collection", "sample collected on", "specimen collected on", "collected date", "sample date", "specimen date", "collected on", "collected at", "coll. date", "sample coll.", "specimen coll.", "coll dt"),
    "test": ("date of test", "test date", "observation date", "date of observation", "date of examination", "examination date", "examined on", "tested on", "tested", "testing date", "testing", "performed on", "analysis date", "date of analysis", "test dt"),
    "result": ("result date", "date of result", "results on", "resulted on", "result dt"),
    "report": ("report date", "date of report", "reported on", "issue date", "date of issue", "report issue date", "authorized on", "released on", "reporting date", "report dt", "printed on", "print date", "date of print", "generated on"),
    "administrative": ("registration date", "reg. date", "date of registration", "admission date", "adm. date", "date of admission", "billing date", "bill date", "invoice date", "date of birth", "birth date", " dob"),
}


def _label(kind: str) -> str:
    spelled = (re.escape(p.strip()).replace(r"\ ", r"\s+").replace(r"\.", r"\.?\s*") for p in DATE_LABELS[kind])
    return "(?:" + "|".join((r"\b" if p.startswith(" ") else "") + s for p, s in zip(DATE_LABELS[kind], spelled, strict=True)) + ")"


def dates_in(lines: Column) -> Column:
    """Array of (line_no, place, raw, date, kind, confidence) over an array of lines, in order. A date's kind is that of the label
    right before it; without one it is administrative on a line with such a label, else unlabelled."""

    def of_line(line: Column, i: Column) -> Column:
        office = line.rlike("(?i)" + _label("administrative"))
        both = F.zip_with(F.regexp_extract_all(line, F.lit(_AROUND), F.lit(1)), F.regexp_extract_all(line, F.lit(_AROUND), F.lit(2)), lambda head, raw: _struct(head=head, raw=raw))

        def one(m: Column, j: Column) -> Column:
            ends = lambda k: m["head"].rlike(rf"(?i){_label(k)}[\s:|=–—\-#.]*$")
            kind = F.when(ends("collection"), "collection")
            for k in ("test", "result", "report", "administrative"):
                kind = kind.when(ends(k), k)
            kind = kind.when(office, "administrative").otherwise("unlabelled")
            of_kind = lambda k: _struct(line_no=i + 1, place=j + 1, raw=m["raw"], date=scalar.parse_date_any(m["raw"]), kind=k, confidence=scalar.date_confidence(k))
            return scalar.let(kind, of_kind)

        found = F.filter(F.transform(both, one), lambda d: d["date"].isNotNull())
        return F.when(line.rlike(_ANY_DATE), found)

    return F.flatten(F.array_compact(F.transform(lines, of_line)))


def best_date(found: Column) -> Column:
    """The date that speaks for them all, by its kind's rank, then by place; administrative ones never do."""
    ranked = F.transform(F.filter(found, lambda d: d["kind"] != "administrative"), lambda d: _struct(rank=scalar.date_rank(d["kind"]), line_no=d["line_no"], place=d["place"], d=d))
    return F.array_min(ranked)["d"]


def dates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, place, raw, date, kind, confidence: all dates of the lines."""
    return df.select(key, F.inline(dates_in(split_lines(F.col(text)))))


def document_date(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, date, kind, confidence, line_no: one row for each document that has such a date."""
    # spread out, as a filter on it would be evaluated below as well
    best = F.array_compact(F.array(best_date(dates_in(split_lines(F.col(text))))))
    return df.select(key, F.inline(best)).select(key, "date", "kind", "confidence", "line_no")


# --- named tests ---
#: Panel, test and its spellings, the first to be tried first: fixed values.
LAB_TESTS = (
    ("CBC", "Haemoglobin", ("haemoglobin (hb)", "hemoglobin (hb)", "haemoglobin", "hemoglobin", "hb.", "hgb", "hb")),
    ("CBC", "WBC", ("total leucocyte count", "total leukocyte count", "total wbc count", "white blood cells", "white blood cell", "leukocytes", "leucocytes", "wbc", "tlc")),
    ("CBC", "RBC", ("rbc", "red blood cell", "red blood cells", "erythrocytes", "total rbc count")),
    ("CBC", "Platelets", ("platelet count", "plt. count", "plt count", "platelets", "plt", "thrombocytes")),
    ("CBC", "Hematocrit", ("hematocrit", "haematocrit", "pcv", "packed cell volume")),
    ("CBC", "MCV", ("mcv", "mean corpuscular volume")),
    ("CBC", "MCH", ("mch", "mean corpuscular haemoglobin", "mean corpuscular hemoglobin")),
    ("CBC", "MCHC", ("mchc", "mean corpuscular haemoglobin concentration", "mean corpuscular hemoglobin concentration")),
    ("CBC", "Neutrophils", ("neutrophils", "neutrophil", "neut", "segs", "segmented neutrophils")),
    ("CBC", "Lymphocytes", ("lymphocytes", "lymphocyte", "lymph")),
    ("CBC", "Monocytes", ("monocytes", "monocyte", "mono")),
    ("CBC", "Eosinophils", ("eosinophils", "eosinophil", "eos")),
    ("CBC", "Basophils", ("basophils", "basophil", "baso")),
    ("Lipid Profile", "Total Cholesterol", ("serum cholesterol", "cholesterol total", "total cholesterol", "cholesterol")),
    ("Lipid Profile", "LDL Cholesterol", ("ldl cholesterol", "ldl-c", "low density lipoprotein", "ldl")),
    ("Lipid Profile", "HDL Cholesterol", ("h.d.l. cholesterol", "hdl cholesterol", "hdl-c", "high density lipoprotein", "hdl")),
    ("Lipid Profile", "Triglycerides", ("triglycerides", "triglyceride", "tg", "trigs")),
    ("Lipid Profile", "VLDL Cholesterol", ("vldl cholesterol", "vldl-c", "vldl", "very low density lipoprotein")),
    ("Lipid Profile", "Non-HDL Cholesterol", ("non-hdl cholesterol", "non hdl cholesterol", "non hdl", "non-hdl")),
    ("Lipid Profile", "TC/HDL Ratio", ("tc/hdl", "cholesterol/hdl ratio", "total cholesterol/hdl")),
    ("Thyroid", "TSH", ("tsh(ultrasensitive)", "tsh (ultrasensitive)", "thyroid stimulating hormone", "thyrotropin", "tsh")),
    ("Thyroid", "T3", ("t3", "triiodothyronine", "total t3", "serum t3")),
    ("Thyroid", "T4", ("t4", "thyroxine", "total t4", "serum t4")),
    ("Thyroid", "Free T3", ("free t3", "ft3", "free triiodothyronine")),
    ("Thyroid", "Free T4", ("free t4", "ft4", "free thyroxine")),
    ("HbA1c", "HbA1c", ("glycosylated hemoglobin (hba1c)", "glycosylated haemoglobin (hba1c)", "glycated haemoglobin", "glycated hemoglobin", "glycosylated haemoglobin", "glycosylated hemoglobin", "hb a1c", "hba1c", "a1c")),
    ("HbA1c", "eAG (Est. Avg Glucose)", ("estimated average glucose (eag)", "estimated average glucose", "eag")),
)
_AFTER = rf"[\s:|=.]+({_NUM})(?![/:-]?\d)(?:[ \t|]*({_UNIT}))?(?:[ \t|]*[(\[]?\s*({_NUM})\s*(?:-|–|to)\s*({_NUM})\s*[)\]]?)?"


def lab_values(df: DataFrame, key: str, text: str, tests: Sequence[tuple[str, str, Sequence[str]]] = LAB_TESTS) -> DataFrame:
    """key, panel, test, value, unit, ref_low, ref_high, date, date_kind, date_confidence: of each named test the first place in the
    text where one of its spellings (not within a word) stands before a number. The date is the line's own, else the
    document's."""
    # with the character before, so that the first place of a hit's text is the hit
    spelled = lambda names: "(?i)(?:^|[^A-Za-z0-9])(?:" + "|".join(re.escape(n).replace(r"\ ", " +") for n in names) + ")" + _AFTER

    def of_text(x: Column) -> Column:
        body = x["body"]
        # a plain search of each spelling's first word leaves out most expressions
        met = lambda names: reduce(Column.__or__, (F.contains(x["low"], F.lit(w)) for w in sorted({n.split()[0] for n in names})))
        hits = F.array_compact(F.array(*(F.when(met(names), _struct(panel=F.lit(panel), test=F.lit(test), hit=F.regexp_extract(body, spelled(names), 0))) for panel, test, names in tests)))

        # the lines that a hit begins and ends in
        def with_line(h: Column, at: Column) -> Column:
            before = F.when(~F.startswith(h["hit"], F.lit("\n")), F.substring_index(F.substring(body, F.lit(1), at - 1), "\n", -1)).otherwise("")
            behind = F.substring_index(F.substring(body, at + F.length(h["hit"]), F.length(body)), "\n", 1)
            return F.concat(before, F.regexp_replace(h["hit"], "^\n", ""), behind)

        def dated(h: Column, whole: Column) -> Column:
            line = scalar.let(F.position(h["hit"], body), lambda at: with_line(h, at))
            return h.withField("d", F.coalesce(best_date(dates_in(F.array(line))), whole))

        return scalar.let(best_date(dates_in(F.split(body, "\n"))), lambda whole: F.transform(F.filter(hits, lambda h: h["hit"] != ""), lambda h: dated(h, whole)))

    # the text is put together once, not wherever an expression reads it
    found = scalar.let(F.array_join(split_lines(F.col(text)), "\n"), lambda body: scalar.let(_struct(body=body, low=F.lower(body)), of_text))
    rows = df.select(key, F.inline(found))
    last = "(?i)" + _AFTER + "$"
    part = lambda i: F.nullif(F.regexp_extract("hit", last, i), F.lit(""))
    return rows.select(
        key, "panel", "test", _number(part(1)).alias("value"), part(2).alias("unit"), _number(part(3)).alias("ref_low"), _number(part(4)).alias("ref_high"),
        F.col("d.date").alias("date"), F.col("d.kind").alias("date_kind"), F.col("d.confidence").alias("date_confidence"),
    )


# --- medicines ---
#: Signs of a medicine line, words that rule one out (those with * go on), and headers of instructions: fixed values.
STRENGTHS = ("mg", "mcg", "µg", "g", "ml", "iu", "unit", "units")
FORMS = ("tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules", "syrup", "ointment", "cream", "drops", "injection")
RULED_OUT = ("allerg*", "reaction", "avoid", "stop", "discontinu*", "not taking", "history", "previous", "follow up", "follow-up", "followup", "patient", "age", "weight", "pressure", "cholesterol", "glucose", "haemoglobin", "hemoglobin", "creatinine", "result", "reference", "range")
INSTRUCTIONS = ("instruction", "dose", "dosage", "schedule", "direction", "directions", "sig")
_words = lambda of: r"(?i)\b(?:" + "|".join(re.escape(w).replace(r"\*", r"\w*") for w in of) + r")\b"
_STRENGTH = r"(?i)\b\d+(?:\.\d+)?\s*(?:" + "|".join(STRENGTHS) + r")\b"
_INSTRUCTS = r"(?i)^(?:" + "|".join(INSTRUCTIONS) + r")\s*:\s*"
_NUMBERED, _LABELLED = r"^\d+[.)]\s+", r"(?i)^(?:medication|medicine)\s*:\s*"


def medicine_lines(df: DataFrame, key: str, text: str, reach: int = 4, most: int = 30) -> DataFrame:
    """key, line_no, name, schedule, evidence: lines that name a strength and are numbered, labelled or name a form, without
    words that rule them out. The schedule is an instruction on the next line that isn't blank, if that is at most ``reach``
    lines below; longer ones than 200 characters are left empty, never cut. At most ``most`` of a document, the first ones."""
    lines = split_lines(F.col(text))
    df = df.select(key, lines.alias("lines_"))

    def entry(raw: Column, i: Column) -> Column:
        below = F.slice("lines_", i + 2, F.lit(reach))
        gap = F.array_min(F.filter(F.transform(below, lambda x, j: F.when(F.trim(x) != "", j + 1)), lambda j: j.isNotNull()))
        return _struct(line_no=i + 1, line=F.trim(raw), gap=gap, next=F.trim(F.try_element_at(below, gap)))

    line = lambda x: x["line"]
    shaped = lambda x: line(x).rlike(_STRENGTH) & (line(x).rlike(_NUMBERED) | line(x).rlike(_LABELLED) | line(x).rlike(_words(FORMS)))
    fits = lambda x: (F.length(line(x)) <= 350) & shaped(x) & ~line(x).rlike(_words(RULED_OUT)) & ~line(x).rlike(_INSTRUCTS)
    name = lambda x: F.regexp_replace(F.regexp_replace(line(x), r"^\d+[.)]\s*", ""), _LABELLED, "")
    found = F.filter(F.transform(F.filter(F.transform("lines_", entry), fits), lambda x: x.withField("name", name(x))), lambda x: F.length(x["name"]) <= 200)
    told = F.when(F.col("next").rlike(_INSTRUCTS), F.regexp_replace("next", _INSTRUCTS, ""))
    schedule = F.when(F.length(told) <= 200, told)
    with_gap = F.rtrim(F.array_join(F.slice("lines_", F.col("line_no") + 1, F.coalesce("gap", F.lit(0))), "\n"))
    rows = df.select(key, "lines_", F.inline(F.slice(found, 1, most)))
    evidence = F.when(schedule.isNotNull(), F.concat("line", F.lit("\n"), with_gap)).otherwise(F.col("line"))
    return rows.select(key, "line_no", "name", F.coalesce(schedule, F.lit("")).alias("schedule"), evidence.alias("evidence"))
