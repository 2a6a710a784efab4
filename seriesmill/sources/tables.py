"""Sources and sinks: explicit schemas, no inference; rows that can't be read keep null where a value was bad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVATION = (
    "id string, dataset string, source_patient_id string, observation_ts timestamp_ntz, analyte_raw string, code string, value_numeric double, value_text string, unit string, "
    "reference_low double, reference_high double, flag string"
)
REQUIRED = ("DATE", "PATIENT", "CODE", "DESCRIPTION", "VALUE")


def _csv(spark: SparkSession, path: str, columns: list[str], required: tuple[str, ...]) -> DataFrame:
    """CSV by header name, whatever the case, order and outer blanks; required columns must be there. Values are trimmed."""
    header = spark.read.option("header", True).csv(path).columns
    have = {c.strip().upper(): c for c in header}
    if missing := [c for c in required if c.upper() not in have]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    raw = spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in header)).csv(path)
    return raw.select(*(F.trim(F.col(f"`{have[c.upper()]}`")).alias(c) if c.upper() in have else F.lit(None).cast("string").alias(c) for c in columns))


def _when(c: str):
    return F.coalesce(F.try_to_timestamp(F.col(c)), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def _canonical(df: DataFrame, dataset: str, key: tuple[str, ...], **columns) -> DataFrame:
    """The canonical table; an id is a digest of the row's own key, so it doesn't depend on partitions."""
    names = [c.split()[0] for c in OBSERVATION.split(", ")]
    made = {"id": F.sha2(F.concat_ws("|", F.lit(dataset), *key), 256), "dataset": F.lit(dataset)} | columns
    kinds = dict(c.split() for c in OBSERVATION.split(", "))
    return df.select(*(made.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))


def read_observations_csv(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, ["DATE", "PATIENT", "ENCOUNTER", "CODE", "DESCRIPTION", "VALUE", "UNITS", "TYPE"], REQUIRED)
    number = F.col("VALUE").try_cast("double")
    return _canonical(
        df, "observations", ("PATIENT", "DATE", "CODE", "DESCRIPTION", "VALUE"), source_patient_id=F.col("PATIENT"), observation_ts=_when("DATE"), analyte_raw=F.col("DESCRIPTION"), code=F.col("CODE"),
        value_numeric=number, value_text=F.when(number.isNull(), F.col("VALUE")), unit=F.col("UNITS"),
    )


def read_labevents_csv(spark: SparkSession, events: str, items: str) -> DataFrame:
    e = _csv(spark, events, ["labevent_id", "subject_id", "itemid", "charttime", "valuenum", "value", "valueuom", "ref_range_lower", "ref_range_upper", "flag"], ("labevent_id", "subject_id", "itemid"))
    i = _csv(spark, items, ["itemid", "label", "loinc_code"], ("itemid", "label"))
    df = e.join(i, "itemid", "left")
    number = F.coalesce(F.col("valuenum").try_cast("double"), F.col("value").try_cast("double"))
    return _canonical(
        df, "labevents", ("labevent_id",), source_patient_id=F.col("subject_id"), observation_ts=_when("charttime"), analyte_raw=F.coalesce("label", F.concat(F.lit("ITEM_"), "itemid")), code=F.col("loinc_code"),
        value_numeric=number, value_text=F.when(number.isNull(), F.col("value")), unit=F.col("valueuom"), reference_low=F.col("ref_range_lower").try_cast("double"), reference_high=F.col("ref_range_upper").try_cast("double"), flag=F.col("flag"),
    )


def read_records_jsonl(spark: SparkSession, path: str, schema: str = OBSERVATION, defaults: dict | None = None) -> DataFrame:
    """JSON lines by schema; missing keys take their defaults."""
    df = spark.read.schema(schema).json(path)
    return df.select(*(F.coalesce(c, F.lit(defaults[c])).alias(c) if defaults and c in defaults else F.col(c) for c in df.columns))


def read_knowledge_text(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: header lines SOURCE, LICENCE and URL, then the text after a line of dashes."""
    raw = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = lambda n: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{n}:(.*)$", 1)), F.lit(""))
    parts = F.split("value", r"\n---+\n", 2)
    return raw.select("path", head("SOURCE").alias("source"), head("LICENCE").alias("licence"), head("URL").alias("url"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))), r"^\s+|\s+$", "").alias("text"))


def write_partitioned(df: DataFrame, path: str, by: str, form: str = "parquet") -> None:
    df.write.partitionBy(by).mode("overwrite").format(form).save(path)


def append_values(df: DataFrame, path: str, t: str) -> None:
    """Appends the dated rows."""
    df.filter(F.col(t).isNotNull()).write.mode("append").parquet(path)


def save_run(path: str, run_id: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").json(f"{path}/{name}")


def ingest_cohort(spark: SparkSession, path: str, out: str, items: str | None = None, vocabulary: DataFrame | None = None, per_intent: int = 12, abnormal: Column | None = None) -> dict[str, DataFrame]:
    """CSV to canonical table, mapped to a ``vocabulary`` (``terminology.VOCABULARY``) if there is one, split by patient, with benchmark
    questions and an audit: written under ``out``, read back from there. ``items``: the dictionary of lab events, if ``path`` has
    those. Measures are known by their canonical name, unmapped ones by their own.

    -> observations, counts, audit, queries (at most ``per_intent`` of each intent, patients taking turns), summary (by split: patients,
    records, mapped records, queries)."""
    from ..operators import aggregates, cohort, terminology

    raw = read_labevents_csv(spark, path, items) if items else read_observations_csv(spark, path)
    if vocabulary is not None:
        raw = terminology.map_measures(raw, vocabulary)
    names = {"source_patient_id": "patient_id", "observation_ts": "ts", "value_numeric": "value"}
    obs = raw.withColumnsRenamed(names).withColumn("analyte", F.coalesce("analyte_canonical", "analyte_raw") if vocabulary is not None else F.col("analyte_raw"))
    write_partitioned(obs.join(cohort.split_exact(obs, "patient_id"), "patient_id"), f"{out}/observations", "split")
    stored = spark.read.parquet(f"{out}/observations")
    aggregates.quality_audit(stored).write.mode("overwrite").json(f"{out}/audit")
    odd = F.lower("flag").isin("abnormal", "high", "low") if abnormal is None else abnormal
    asked = cohort.sample_benchmark(cohort.query_candidates(stored.filter("ts is not null"), F.coalesce(odd, F.lit(False))), per_intent)
    split_of = stored.select("patient_id", "split").distinct()
    asked.join(split_of, "patient_id").write.mode("overwrite").parquet(f"{out}/queries")
    queries = spark.read.parquet(f"{out}/queries")
    mapped = F.count_if(F.col("mapping_status") != "unmapped") if vocabulary is not None else F.lit(0).cast("long")
    per = stored.groupBy("split").agg(F.count_distinct("patient_id").alias("patients"), F.count(F.lit(1)).alias("records"), mapped.alias("mapped"))
    summary = per.join(queries.groupBy("split").agg(F.count(F.lit(1)).alias("queries")), "split", "left").na.fill(0, ["queries"])
    return {"observations": stored, "counts": aggregates.cohort_counts(stored), "audit": spark.read.json(f"{out}/audit"), "queries": queries, "summary": summary}
