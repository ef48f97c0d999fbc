"""Cohort metadata: patients, admissions, diagnoses, and the timelines of services and units."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.text import title_case
from cohortlens.operators.guards import none_left, require_columns
from cohortlens.operators.search import remove_keywords, rewindow, with_negation
from cohortlens.operators.tokens import PhraseLearner, learned_on_train, token_views

# The group of each of the hospital's race codes. Others stay as they are.
RACES = {
    "WHITE": "White or Caucasian",
    "BLACK/AFRICAN AMERICAN": "Black or African American",
    "BLACK/AFRICAN": "Black or African American",
    "BLACK/CAPE VERDEAN": "Black or African American",
    "BLACK/CARIBBEAN ISLAND": "Black or African American",
    "WHITE - RUSSIAN": "White or Caucasian",
    "WHITE - EASTERN EUROPEAN": "White or Caucasian",
    "WHITE - BRAZILIAN": "White or Caucasian",
    "WHITE - OTHER EUROPEAN": "White or Caucasian",
    "PORTUGUESE": "Portuguese",
    "AMERICAN INDIAN/ALASKA NATIVE": "American Indian or Native",
    "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER": "American Indian or Native",
    "MULTIPLE RACE/ETHNICITY": "Mixed",
    "HISPANIC OR LATINO": "Hispanic or Latino",
    "HISPANIC/LATINO - PUERTO RICAN": "Hispanic or Latino",
    "HISPANIC/LATINO - COLUMBIAN": "Hispanic or Latino",
    "HISPANIC/LATINO - CUBAN": "Hispanic or Latino",
    "HISPANIC/LATINO - DOMINICAN": "Hispanic or Latino",
    "HISPANIC/LATINO - GUATEMALAN": "Hispanic or Latino",
    "HISPANIC/LATINO - HONDURAN": "Hispanic or Latino",
    "HISPANIC/LATINO - MEXICAN": "Hispanic or Latino",
    "HISPANIC/LATINO - SALVADORAN": "Hispanic or Latino",
    "HISPANIC/LATINO - CENTRAL AMERICAN": "Hispanic or Latino",
    "SOUTH AMERICAN": "South American",
    "ASIAN": "Asian",
    "ASIAN - SOUTH EAST ASIAN": "Asian",
    "ASIAN - KOREAN": "Asian",
    "ASIAN - ASIAN INDIAN": "Asian",
    "ASIAN - CHINESE": "Asian",
    "OTHER": "Other",
    "UNKNOWN": "Unknown",
    "UNABLE TO OBTAIN": "Unknown",
    "PATIENT DECLINED TO ANSWER": "Unknown",
}


def recode(c: Column, table: Mapping[str, str]) -> Column:
    """What the table has for the value, or the value itself."""
    held = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(held, c), c)


def patients(df: DataFrame) -> DataFrame:
    """Patients under canonical names; gender spelled out, and null if it is neither M nor F."""
    require_columns(df, "subject_id", "gender", "anchor_age", "anchor_year_group")
    gender = F.when(F.col("gender") == "M", "Male").when(F.col("gender") == "F", "Female")
    return df.select(F.col("subject_id").alias("enterprise_mrn"), gender.alias("patient_gender"), F.col("anchor_age").alias("patient_age"), F.col("anchor_year_group").alias("patient_time_period"))


def admissions(df: DataFrame) -> DataFrame:
    """Admissions under canonical names, with times parsed and codes recoded."""
    require_columns(df, "hadm_id", "subject_id", "admittime", "dischtime", "admission_type", "race", "language", "marital_status", "insurance")
    marital = F.when(F.col("marital_status").startswith("UNKNOWN"), "Unknown").otherwise(title_case(F.col("marital_status")))
    language = F.when(F.col("language") == "?", "Unknown").otherwise(title_case(F.col("language")))
    return df.select(
        F.col("hadm_id").alias("encounter_id"), F.col("subject_id").alias("enterprise_mrn"), F.to_timestamp("admittime").alias("encounter_date_start"), F.to_timestamp("dischtime").alias("encounter_date_end"),
        title_case(F.col("admission_type")).alias("patient_admission_type"), recode(F.col("race"), RACES).alias("patient_race"), language.alias("patient_language"), marital.alias("patient_marital_status"), F.col("insurance").alias("patient_insurance_type"),
    )


def icd_rollup(df: DataFrame, versions: tuple[int, ...] = (9, 10), order_col: str = "seq_num") -> DataFrame:
    """encounter_id and, per version, its codes joined by "; " in the order of ``order_col``; null without any.

    One aggregation gives what a full outer join of one roll-up per version would.
    """
    require_columns(df, "hadm_id", "icd_version", "icd_code", order_col)
    rows = df.where(F.col("icd_code").isNotNull() & F.col("icd_version").isin(list(versions)))

    def codes(v: int) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("icd_version") == v, F.struct(F.col(order_col), F.col("icd_code")))))
        return F.nullif(F.array_join(F.transform(held, lambda x: x["icd_code"]), "; "), F.lit("")).alias(f"patient_icd_{v}_codes")

    return rows.groupBy(F.col("hadm_id").alias("encounter_id")).agg(*[codes(v) for v in versions])


def cohort_metadata(admitted: DataFrame, people: DataFrame, codes: DataFrame) -> DataFrame:
    """Every admission with its patient's columns and its codes, where there are any."""
    return admitted.join(people, "enterprise_mrn", "left").join(codes, "encounter_id", "left")


def service_timeline(services: DataFrame, keys: tuple[str, ...] = ("subject_id", "hadm_id"), ts: str = "transfertime") -> DataFrame:
    """Each service with its start and the start of the next, null for the last of an encounter."""
    order = Window.partitionBy(*keys).orderBy(ts, "curr_service")  # equal times go by name
    return services.select(*keys, F.col(ts).alias("start"), F.lead(ts).over(order).alias("end"), "curr_service")


def number_lone_transfers(transfers: DataFrame, order: tuple[str, ...] = ("intime", "outtime", "eventtype", "careunit")) -> DataFrame:
    """Transfers without an encounter get -1, -2, ... within their patient, by time; equal times by their other columns."""
    lone = F.col("hadm_id").isNull()
    ordinal = F.row_number().over(Window.partitionBy("subject_id", lone).orderBy(*order))
    return transfers.withColumn("hadm_id", F.coalesce("hadm_id", -ordinal.cast("long")))


def transfer_timeline(transfers: DataFrame) -> DataFrame:
    """(subject_id, hadm_id, stays): the stays of an encounter in order of time."""
    stay = F.struct("intime", "outtime", "eventtype", "careunit")
    return transfers.groupBy("subject_id", "hadm_id").agg(F.array_sort(F.collect_list(stay)).alias("stays"))


def service_and_unit(services: DataFrame, transfers: DataFrame, strict: bool = True) -> DataFrame:
    """(subject_id, hadm_id, service, unit): an encounter's last service, and the unit of the stay before its last.

    The last stay must be a discharge; with ``strict`` another one raises ValueError, else the unit is null.
    """
    last = services.groupBy("subject_id", "hadm_id").agg(F.max_by("curr_service", F.struct("transfertime", "curr_service")).alias("service"))
    stays = F.col("stays")
    n = F.size(stays)
    ended = transfer_timeline(transfers).select("subject_id", "hadm_id", F.get(stays, n - 1)["eventtype"].alias("final"), F.get(stays, n - 2)["careunit"].alias("unit"))
    if strict:
        none_left(ended.where(~F.coalesce(F.col("final") == "discharge", F.lit(False))), "timelines that don't end with a discharge")
    unit = F.when(F.col("final") == "discharge", F.col("unit"))
    return last.join(ended.select("subject_id", "hadm_id", unit.alias("unit")), ["subject_id", "hadm_id"], "full")


def attach_service_unit(notes: DataFrame, timeline: DataFrame, strict: bool = True) -> DataFrame:
    """Notes with encounter_note_service and encounter_note_unit; ValueError for a note without a timeline if ``strict``."""
    held = timeline.select(F.col("subject_id").alias("enterprise_mrn"), F.col("hadm_id").alias("encounter_id"), F.col("service").alias("encounter_note_service"), F.col("unit").alias("encounter_note_unit"))
    keys = ["enterprise_mrn", "encounter_id"]
    if strict:
        none_left(notes.join(held, keys, "left_anti").select(*keys), "notes without a timeline")
    return notes.join(held, keys, "left")


def restrict_to_notes(metadata: DataFrame, notes: DataFrame) -> DataFrame:
    """Metadata of the encounters that have a note, with the note's service and unit; ValueError if one has two notes."""
    none_left(notes.groupBy("encounter_id").count().where("count > 1"), "encounters with more than one note")
    held = notes.select("encounter_id", "encounter_note_service", "encounter_note_unit")
    return metadata.join(held, "encounter_id")


def annotation_metadata(metadata: DataFrame, split: DataFrame, notes: DataFrame | None = None, annotated: DataFrame | None = None) -> DataFrame:
    """Metadata with the patient's split; with ``notes``, one row per note; with ``annotated``, only its notes or encounters."""
    out = metadata.join(split, "enterprise_mrn", "left")
    if notes is not None:
        out = out.join(notes, ["encounter_id", "enterprise_mrn"])
    if annotated is not None:
        key = "encounter_note_id" if notes is not None else "encounter_id"
        out = out.join(annotated.select(key).distinct(), key, "left_semi")
    return out


def model_table(annotations: DataFrame, metadata: DataFrame, on: str = "encounter_id") -> DataFrame:
    """Annotations with the metadata of their encounter or note; of columns in both, the annotation's stay."""
    both = [c for c in metadata.columns if c in annotations.columns and c != on]
    return annotations.join(metadata.drop(*both), on, "left")


def prepare_model_data(annotations: DataFrame, metadata: DataFrame, id_col: str, full_text_col: str | None = None, context: int | None = None, phrase_passes: int = 0, min_count: int = 5, threshold: float = 10.0, remove: list[str] | None = None) -> tuple[DataFrame, dict]:
    """The table that models train on, and the parameters and learners that made it.

    In order: metadata joined, windows cut anew if asked, negated keywords, tokens without and with the keyword, phrases learned on
    the train rows for both, keywords removed.
    """
    require_columns(annotations, id_col, "keyword", "note_text")
    out = model_table(annotations, metadata)
    if context is not None:
        if full_text_col is None:
            raise ValueError("a new context needs the column of the full text")
        out = rewindow(out, full_text_col, context)
    out = token_views(with_negation(out, "note_text"))
    learners = {}
    for col in ("tokens", "tokens_full") if phrase_passes else ():
        learners[col] = PhraseLearner(phrase_passes, min_count, threshold)
        out = learned_on_train(out, learners[col], id_col, col)
    if remove:
        out, unknown = remove_keywords(out, remove)
        if unknown:
            warnings.warn(f"keywords to remove that no row has: {unknown}", stacklevel=2)
    return out, {"context": context, "phrase_passes": phrase_passes, "min_count": min_count, "threshold": threshold, "removed": list(remove or ()), "learners": learners}


def domain_cohort(df: DataFrame, races: tuple[str, ...], train_only: bool = False) -> DataFrame:
    """Encounter types by service, small race groups as Other, unknown race and sex out; nulls stay."""
    if train_only:
        df = df.where(F.col("split") == "train")
    df = df.withColumn("encounter_type", F.col("encounter_note_service"))
    race = F.when(F.col("patient_race").isNull() | F.col("patient_race").isin(*races, "Unknown"), F.col("patient_race")).otherwise("Other")
    df = df.withColumn("patient_race", race)
    unknown = F.coalesce((F.col("patient_race") == "Unknown") | (F.col("patient_gender") == "Unknown"), F.lit(False))
    return df.where(~unknown)
