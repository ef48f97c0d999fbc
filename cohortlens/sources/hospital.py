"""Hospital tables: compressed CSV files with headers, under declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.text import clean_text, normalize_text
from cohortlens.operators.cohort import attach_service_unit, number_lone_transfers, service_and_unit
from cohortlens.operators.guards import require_columns
from cohortlens.operators.splits import sample_blocks

SCHEMAS = {
    "patients": "subject_id BIGINT, gender STRING, anchor_age INT, anchor_year_group STRING",
    "admissions": "subject_id BIGINT, hadm_id BIGINT, admittime TIMESTAMP, dischtime TIMESTAMP, admission_type STRING, race STRING, language STRING, marital_status STRING, insurance STRING",
    "diagnoses_icd": "subject_id BIGINT, hadm_id BIGINT, seq_num INT, icd_code STRING, icd_version INT",
    "services": "subject_id BIGINT, hadm_id BIGINT, transfertime TIMESTAMP, curr_service STRING",
    "transfers": "subject_id BIGINT, hadm_id BIGINT, transfer_id BIGINT, intime TIMESTAMP, outtime TIMESTAMP, eventtype STRING, careunit STRING",
    "discharge": "note_id STRING, subject_id BIGINT, hadm_id BIGINT, note_type STRING, note_seq INT, charttime STRING, storetime STRING, text STRING",
}
NOTE_NAMES = {"note_id": "encounter_note_id", "subject_id": "enterprise_mrn", "hadm_id": "encounter_id", "note_type": "encounter_type", "charttime": "encounter_date", "storetime": "encounter_date_aux", "text": "note_text"}
ANNOTATION_COLUMNS = ("enterprise_mrn", "encounter_id", "encounter_note_id", "encounter_type", "encounter_date", "encounter_note_service", "encounter_note_unit", "keyword_category", "keyword", "start", "end", "note_text", "label")


def _csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The file's columns by name, cast to the schema's types; columns that the schema lacks are not kept.

    Gzip files can't be split, so what follows starts with a shuffle to spread their rows.
    """
    declared = T._parse_datatype_string(schema)
    rows = spark.read.options(header="true", **options).csv(path)
    require_columns(rows, *[f.name for f in declared if f.name not in ("subject_id", "seq_num", "transfer_id") or f.name in rows.columns])
    rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared if f.name in rows.columns])
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))) if path.endswith(".gz") else rows


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the hospital's tables of numbers and codes."""
    if name not in SCHEMAS or name == "discharge":
        raise KeyError(f"unknown table: {name}")
    return _csv(spark, path, SCHEMAS[name])


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Discharge notes: Latin-1, texts of many lines, quotes doubled."""
    return _csv(spark, path, SCHEMAS["discharge"], encoding="ISO-8859-1", multiLine="true", escape='"')


def load_notes(raw: DataFrame, services: DataFrame, transfers: DataFrame, clean: bool = True, normalize: bool = True, note_ids: DataFrame | None = None, position_col: str | None = None, chunk_size: int = 1000, chunk_share: float = 1.0, note_share: float = 1.0, seed: int = 42, strict: bool = True) -> DataFrame:
    """Notes under canonical names with the service and unit of their encounter.

    Sampling takes whole chunks of notes by ``position_col`` then a share of each. The result is lazy: nothing is read until an action.
    """
    if chunk_share < 1 or note_share < 1:
        if position_col is None:
            raise ValueError("sampling by chunk needs the notes' position")
        raw = sample_blocks(raw, position_col, chunk_size, chunk_share, note_share, seed).drop("block")
    if note_ids is not None:
        raw = raw.join(note_ids.select("note_id").distinct(), "note_id", "left_semi")
    text = F.col("text")
    text = clean_text(text) if clean else text
    text = normalize_text(text) if normalize else text
    notes = raw.withColumn("text", text).withColumnsRenamed(NOTE_NAMES)
    timeline = service_and_unit(services, number_lone_transfers(transfers), strict)
    return attach_service_unit(notes, timeline, strict)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Labelled windows; KeyError that lists the required columns it lacks."""
    rows = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    require_columns(rows, *ANNOTATION_COLUMNS)
    return rows.withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int"))
