"""Raw names and codes of measures brought to a vocabulary: canonical name, concept, code and unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A vocabulary: one row for each measure; codes and aliases (lower case) stand for one measure each.
VOCABULARY = "canonical string, code string, unit string, aliases array<string>"


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def spellings(raw: Column) -> Column:
    """What a raw name may be looked up by, in order: itself, itself without bracket signs, without what stands in brackets, and
    what stands in each pair of brackets."""
    name = _plain(F.coalesce(raw, F.lit("")))
    inside = F.transform(F.regexp_extract_all(name, F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.concat(F.array(name, _plain(F.translate(name, "()[]", "    ")), _plain(F.regexp_replace(name, r"\([^)]*\)|\[[^\]]*\]", " "))), inside), lambda x: x != ""))


def map_measures(df: DataFrame, vocabulary: DataFrame, raw: str = "analyte_raw", code: str = "code") -> DataFrame:
    """``df`` with analyte_canonical, concept_id, loinc_code, mapping_status (exact_code, alias, unmapped), and its unit, where it has
    none, from the vocabulary. The code goes before the name; nothing is made up for what is in neither. Only distinct pairs of
    code and name are looked up."""
    names = df.select(F.col(raw).alias("raw_"), F.trim(code).alias("code_")).distinct()
    by_code = vocabulary.filter("code is not null").select(F.trim("code").alias("code_"), F.col("canonical").alias("c1"), F.col("code").alias("k1"), F.col("unit").alias("u1"))
    aliases = vocabulary.select("canonical", "code", "unit", F.explode(F.array_distinct(F.concat(F.array(_plain(F.col("canonical"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), _plain)))).alias("alias"))
    tried = names.select("raw_").distinct().select("raw_", F.posexplode(spellings(F.col("raw_"))).alias("place", "alias"))
    by_name = tried.join(aliases, "alias").groupBy("raw_").agg(F.min_by(F.struct("canonical", "code", "unit"), F.struct("place", "canonical")).alias("r"))
    by_name = by_name.select("raw_", F.col("r.canonical").alias("c2"), F.col("r.code").alias("k2"), F.col("r.unit").alias("u2"))
    known = names.join(by_code, "code_", "left").join(by_name, "raw_", "left").select(
        F.col("raw_").alias("of_raw"), F.col("code_").alias("of_code"), F.coalesce("c1", "c2").alias("analyte_canonical"), F.when(F.col("c1").isNotNull(), F.col("k1")).otherwise(F.col("k2")).alias("loinc_code"),
        F.when(F.col("c1").isNotNull(), F.col("u1")).otherwise(F.col("u2")).alias("unit_"), F.when(F.col("c1").isNotNull(), "exact_code").when(F.col("c2").isNotNull(), "alias").otherwise("unmapped").alias("mapping_status"),
    )
    rows = df.join(known, F.col(raw).eqNullSafe(F.col("of_raw")) & F.trim(code).eqNullSafe(F.col("of_code")))
    kept = [F.coalesce(F.nullif("unit", F.lit("")), "unit_").alias("unit") if c == "unit" else F.col(c) for c in df.columns]
    return rows.select(*kept, "analyte_canonical", F.concat(F.lit("LOINC:"), "loinc_code").alias("concept_id"), "loinc_code", "mapping_status")
