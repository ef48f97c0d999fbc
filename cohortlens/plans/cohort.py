"""Queries on cohort tables, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cohort as co
from cohortlens.operators import splits as sp
from cohortlens.plans.common import LABELLED, MODULUS, draw, draw_sql, labelled, table
from cohortlens.sources.hospital import NOTE_NAMES


def _services(spark: SparkSession, d: str) -> DataFrame:
    """Events as services: the user is the patient, and its id's tens the encounter."""
    return table(spark, d, "events").select(F.col("user_id").alias("subject_id"), F.floor(F.col("user_id") / 10).alias("hadm_id"), F.col("ts").alias("transfertime"), F.col("event_type").alias("curr_service"))


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = F.max("ts").over(_w("user_id"))
    kind = F.when(F.col("ts") == last, "discharge").otherwise("transfer")
    return e.select(F.col("user_id").alias("subject_id"), F.when(F.col("event_id") % 7 > 0, F.floor(F.col("user_id") / 10)).alias("hadm_id"), F.col("event_id").alias("transfer_id"), F.col("ts").alias("intime"), F.lit(None).cast("timestamp").alias("outtime"), kind.alias("eventtype"), F.col("event_type").alias("careunit"))


def _w(*by: str):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def patients(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 3 == 0, "M").when(F.col("c_custkey") % 3 == 1, "F").otherwise("U").alias("gender"), (F.col("c_custkey") % 90).cast("int").alias("anchor_age"), F.col("c_mktsegment").alias("anchor_year_group"))
    return co.patients(c)


def _admissions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    race = F.when(F.col("o_orderkey") % 4 == 0, "BLACK/CAPE VERDEAN").when(F.col("o_orderkey") % 4 == 1, "HISPANIC/LATINO - CUBAN").when(F.col("o_orderkey") % 4 == 2, "UNABLE TO OBTAIN").otherwise("NEW GROUP")
    return o.select(F.col("o_orderkey").alias("hadm_id"), F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").alias("admittime"), (F.col("o_orderdate") + F.expr("interval 2 days")).alias("dischtime"), F.col("o_orderpriority").alias("admission_type"), race.alias("race"), F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise("NON-ENGLISH").alias("language"), F.when(F.col("o_orderkey") % 6 == 0, "UNKNOWN (DEFAULT)").otherwise("MARRIED").alias("marital_status"), F.col("o_orderstatus").alias("insurance"))


def admissions(spark: SparkSession, d: str) -> DataFrame:
    return co.admissions(_admissions(spark, d)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("encounter_date_start", "encounter_date_end")})


def _diagnoses(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("hadm_id"), F.when(F.col("l_linestatus") == "F", 9).otherwise(10).alias("icd_version"), F.when(F.col("l_partkey") % 10 > 0, F.col("l_partkey").cast("string")).alias("icd_code"), F.col("l_linenumber").alias("seq_num"))


def icd_rollup(spark: SparkSession, d: str) -> DataFrame:
    return co.icd_rollup(_diagnoses(spark, d))


def cohort_metadata(spark: SparkSession, d: str) -> DataFrame:
    made = co.cohort_metadata(co.admissions(_admissions(spark, d)), patients(spark, d), co.icd_rollup(_diagnoses(spark, d)))
    return made.groupBy("patient_gender", "patient_race", "patient_language", "patient_marital_status").agg(F.count("*").alias("n"), F.count("patient_icd_9_codes").alias("n9"), F.count("patient_icd_10_codes").alias("n10"), F.sum(F.length("patient_icd_9_codes")).alias("chars9"), F.sum("patient_age").alias("ages"))


def service_timeline(spark: SparkSession, d: str) -> DataFrame:
    t = co.service_timeline(_services(spark, d))
    return t.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


def transfer_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return co.number_lone_transfers(_transfers(spark, d), ("intime", "transfer_id")).select("subject_id", "transfer_id", "hadm_id")


def transfer_timeline(spark: SparkSession, d: str) -> DataFrame:
    t = co.transfer_timeline(co.number_lone_transfers(_transfers(spark, d)))
    return t.select("subject_id", "hadm_id", F.size("stays").alias("n"), F.array_join(F.transform("stays", lambda s: s["careunit"]), ">").alias("units"))


def unit_assignment(spark: SparkSession, d: str) -> DataFrame:
    moved = _transfers(spark, d).withColumn("hadm_id", F.floor(F.col("subject_id") / 10))
    return co.service_and_unit(_services(spark, d), moved)


def notes_with_unit(spark: SparkSession, d: str) -> DataFrame:
    moved = _transfers(spark, d).withColumn("hadm_id", F.floor(F.col("subject_id") / 10))
    timeline = co.service_and_unit(_services(spark, d), moved)
    users = table(spark, d, "events").select("user_id").distinct()
    notes = users.select(F.col("user_id").alias("subject_id"), F.floor(F.col("user_id") / 10).alias("hadm_id"), F.concat(F.lit("n"), "user_id").alias("note_id")).withColumnsRenamed(NOTE_NAMES)
    return co.attach_service_unit(notes, timeline)


def restricted_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = co.admissions(_admissions(spark, d)).select("encounter_id", "patient_race")
    notes = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("encounter_id"), F.col("o_orderstatus").alias("encounter_note_service"), F.col("o_orderpriority").alias("encounter_note_unit"))
    return co.restrict_to_notes(meta, notes)


def annotation_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = co.admissions(_admissions(spark, d)).select("encounter_id", "enterprise_mrn")
    split = sp.group_split(table(spark, d, "customer").select(F.col("c_custkey").alias("enterprise_mrn")), "enterprise_mrn", draw=draw("enterprise_mrn"), scale=MODULUS)
    wanted = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("encounter_id"))
    return co.annotation_metadata(meta, split, annotated=wanted).groupBy("split").agg(F.count("*").alias("n"), F.sum("encounter_id").alias("ids"))


def model_table(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("encounter_id"), "lang")
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("encounter_id"), F.lit("meta").alias("lang"), "source").where("doc_id % 2 = 0")
    return co.model_table(notes, meta)


def domain_cohort(spark: SparkSession, d: str) -> DataFrame:
    a = co.admissions(_admissions(spark, d)).select("encounter_id", "patient_race", F.col("patient_insurance_type").alias("encounter_note_service"), F.when(F.col("encounter_id") % 11 == 0, "Unknown").otherwise("Female").alias("patient_gender"))
    return co.domain_cohort(a, ("Hispanic or Latino",)).groupBy("encounter_type", "patient_race").agg(F.count("*").alias("n"))


def prepared_model_data(spark: SparkSession, d: str) -> DataFrame:
    from cohortlens.operators.lexicon import DEMO
    from cohortlens.operators.search import search_corpus

    notes = table(spark, d, "conversations").select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").alias("encounter_id"), F.concat_ws("-", "conv_id", "turn").alias("encounter_note_id"), F.col("text").alias("note_text"))
    hits = search_corpus(notes, {"cop": DEMO["cop"]}, 4).withColumn("id", F.concat_ws("-", "encounter_note_id", "start"))
    meta = notes.select("encounter_id").distinct().withColumn("split", F.when(F.col("encounter_id") % 5 > 0, "train").otherwise("dev"))
    made, _ = co.prepare_model_data(hits, meta, "id", remove=["was"])
    return made.select("id", "keyword", "split", F.array_join("tokens", " ").alias("tokens"), F.array_join("tokens_full", " ").alias("tokens_full"))


def patient_split(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return sp.no_leak(sp.group_split(o, "o_custkey", draw=draw("o_custkey"), scale=MODULUS), "o_custkey")


def hashed_split(spark: SparkSession, d: str) -> DataFrame:
    o = sp.group_split(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return o.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


def kfold(spark: SparkSession, d: str) -> DataFrame:
    return sp.k_folds(labelled(spark, d).select("doc_id", "lang"), 5, ["lang"], "doc_id", draw=draw("doc_id"))


def grouped_fold(spark: SparkSession, d: str) -> DataFrame:
    return sp.grouped_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, draw=draw("o_custkey"))


def resample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id")
    return sp.resamples(rows, "doc_id", 3, 0.4, draw=draw(F.col("doc_id") + 1000 * F.col("iteration")))


def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(spark, d).select("doc_id", "y")
    return sp.learning_curve(rows, "doc_id", "y", [10, 50], 2, draw=draw(F.col("doc_id") + 1000 * F.col("iteration") + F.col("size")))


def constrained_resample(spark: SparkSession, d: str) -> DataFrame:
    return sp.constrained_resample(labelled(spark, d).select("doc_id", "y"), "doc_id", "y", 0.25, 1, 1, draw=draw("doc_id"))


def sampled_rows(spark: SparkSession, d: str) -> DataFrame:
    return sp.sample_rows(table(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey", draw=draw("o_orderkey"))


def per_keyword_cap(spark: SparkSession, d: str) -> DataFrame:
    return sp.cap_per_keyword(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), 20, "o_orderkey", "o_orderpriority", draw=draw("o_orderkey"))


def block_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id")
    return sp.sample_blocks(rows, "doc_id", 20, 0.5, 0.3, block_draw=draw("block") % 1_000_000, row_draw=draw("doc_id", 7))


_SERVICES = "services as (select user_id as subject_id, user_id // 10 as hadm_id, ts, event_type as service from events)"
_TRANSFERS = "transfers as (select user_id as subject_id, case when event_id % 7 > 0 then user_id // 10 end as hadm_id, event_id as transfer_id, ts, event_type as careunit, case when ts = max(ts) over (partition by user_id) then 'discharge' else 'transfer' end as kind from events)"
_NUMBERED = "numbered as (select * exclude (hadm_id), coalesce(hadm_id, -row_number() over (partition by subject_id, hadm_id is null order by ts, transfer_id)) as hadm_id from transfers)"
_RACE = "case o_orderkey % 4 when 0 then 'Black or African American' when 1 then 'Hispanic or Latino' when 2 then 'Unknown' else 'NEW GROUP' end"
_LANG, _MARITAL = "case when o_orderkey % 5 = 0 then 'Unknown' else 'Non-English' end", "case when o_orderkey % 6 = 0 then 'Unknown' else 'Married' end"
_TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_ICD = "icd as (select l_orderkey as encounter_id, string_agg(l_partkey::varchar, '; ' order by l_linenumber, l_partkey::varchar) filter (l_linestatus = 'F') as patient_icd_9_codes, string_agg(l_partkey::varchar, '; ' order by l_linenumber, l_partkey::varchar) filter (l_linestatus <> 'F') as patient_icd_10_codes from lineitem where l_partkey % 10 > 0 group by 1)"
_GENDER = "case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' end"
_UNITS = f"{_SERVICES}, s as (select subject_id, hadm_id, arg_max(service, ts) as service from services group by all), t as (select user_id as subject_id, user_id // 10 as hadm_id, event_type as careunit, row_number() over (partition by user_id order by ts desc) as k from events), u as (select s.*, t.careunit as unit from s left join t on s.subject_id = t.subject_id and k = 2)"
_TRAIN, _DEV = round(0.7 * MODULUS), round(0.9 * MODULUS)
_SPLIT = "case when {0} < " + str(_TRAIN) + " then 'train' when {0} < " + str(_DEV) + " then 'dev' else 'test' end"

SQL = {
    "patients": f"select c_custkey as enterprise_mrn, {_GENDER} as patient_gender, (c_custkey % 90)::int as patient_age, c_mktsegment as patient_time_period from customer",
    "admissions": f"select o_orderkey as encounter_id, o_custkey as enterprise_mrn, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as encounter_date_start, strftime(o_orderdate + interval 2 days, '%Y-%m-%d %H:%M:%S') as encounter_date_end, {_TITLE.format('o_orderpriority')} as patient_admission_type, {_RACE} as patient_race, {_LANG} as patient_language, {_MARITAL} as patient_marital_status, o_orderstatus as patient_insurance_type from orders",
    "icd_rollup": f"with {_ICD} select * from icd",
    "cohort_metadata": f"with {_ICD} select {_GENDER} as patient_gender, {_RACE} as patient_race, {_LANG} as patient_language, {_MARITAL} as patient_marital_status, count(*) as n, count(patient_icd_9_codes) as n9, count(patient_icd_10_codes) as n10, sum(length(patient_icd_9_codes))::bigint as chars9, sum(c_custkey % 90)::bigint as ages from orders left join customer on c_custkey = o_custkey left join icd on encounter_id = o_orderkey group by 1, 2, 3, 4",
    "service_timeline": f"with {_SERVICES} select subject_id, hadm_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as start, strftime(lead(ts) over (partition by subject_id, hadm_id order by ts), '%Y-%m-%d %H:%M:%S.%f') as \"end\", service as curr_service from services",
    "transfer_ordinal": f"with {_TRANSFERS}, {_NUMBERED} select subject_id, transfer_id, hadm_id from numbered",
    "transfer_timeline": f"with {_TRANSFERS}, {_NUMBERED} select subject_id, hadm_id, count(*)::int as n, string_agg(careunit, '>' order by ts) as units from numbered group by all",
    "unit_assignment": f"with {_UNITS} select * from u",
    "notes_with_unit": f"with {_UNITS} select subject_id as enterprise_mrn, hadm_id as encounter_id, 'n' || subject_id as encounter_note_id, service as encounter_note_service, unit as encounter_note_unit from u",
    "restricted_metadata": f"select o_orderkey as encounter_id, {_RACE} as patient_race, o_orderstatus as encounter_note_service, o_orderpriority as encounter_note_unit from orders where o_orderkey % 3 = 0",
    "annotation_metadata": f"select {_SPLIT.format(draw_sql('o_custkey'))} as split, count(*) as n, sum(o_orderkey)::bigint as ids from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 40) group by 1",
    "model_table": "select d.doc_id as encounter_id, d.lang, case when doc_id % 2 = 0 then source end as source from documents d",
    "domain_cohort": f"with a as (select o_orderstatus as encounter_type, {_RACE} as r, o_orderkey from orders) select encounter_type, case when r in ('Hispanic or Latino', 'Unknown') then r else 'Other' end as patient_race, count(*) as n from a where r <> 'Unknown' and o_orderkey % 11 <> 0 group by 1, 2",
    "patient_split": f"select o_orderkey, o_custkey, {_SPLIT.format(draw_sql('o_custkey'))} as split from orders",
    "kfold": f"select doc_id, lang, ((row_number() over (partition by lang order by {draw_sql('doc_id')}, doc_id) - 1) % 5)::int as fold from documents join labels using (doc_id)",
    "grouped_fold": f"with g as (select o_custkey, ((row_number() over (order by {draw_sql('o_custkey')}, o_custkey) - 1) % 5)::int as fold from (select distinct o_custkey from orders)) select o_orderkey, o_custkey, fold from orders join g using (o_custkey)",
    "resample": f"with r as (select doc_id, i::int as iteration, row_number() over (partition by i order by {draw_sql('doc_id + 1000 * i')}, doc_id) as k from labels, generate_series(0, 2) g(i)) select doc_id, iteration from r where k <= floor((select count(*) from labels) * 0.4)",
    "learning_curve": f"""with {LABELLED}, c as (select count(*) as n, count(distinct y) as k from labelled), s as (select * from (select unnest([10.0, 10.0, 50.0, 50.0, 100.0])::double as percent, unnest([0, 1, 0, 1, 0])::int as iteration)),
      z as (select s.*, (case when percent = 100 then n else greatest(floor(n * percent / 100), k) end)::int as size from s, c), m as (select doc_id, y, percent, iteration, size, {draw_sql('doc_id + 1000 * iteration + size')} as r from labelled, z),
      l as (select *, row_number() over (partition by percent, iteration, y order by r, doc_id) > 1 as later from m), p as (select *, row_number() over (partition by percent, iteration order by later, r, doc_id) as k from l) select doc_id, y, percent, iteration, size from p where k <= size""",
    "constrained_resample": f"""with {LABELLED}, a as (select doc_id, y, {draw_sql('doc_id')} as r, row_number() over (partition by y order by {draw_sql('doc_id')}, doc_id) as k from labelled), b as (select *, case when k <= 1 then 0 when k <= 2 then 2 else 1 end as tier from a), c as (select *, row_number() over (order by tier, r, doc_id) as p from b)
      select doc_id, y, case when tier = 0 or (tier = 1 and p <= round_even((select count(*) from c) * 0.25, 0)) then 'test' else 'train' end as part from c""",
    "sampled_rows": f"select o_orderkey from orders order by {draw_sql('o_orderkey')}, o_orderkey limit 100",
    "per_keyword_cap": f"select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority order by {draw_sql('o_orderkey')}, o_orderkey) as k from orders) where k <= 20",
    "block_sample": f"with b as (select doc_id, doc_id // 20 as block from documents), r as (select *, row_number() over (partition by block order by {draw_sql('doc_id', 7)}, doc_id) as k, count(*) over (partition by block) as n from b where ({draw_sql('block')}) % 1000000 < 500000) select doc_id, block from r where k <= round(n * 0.3)",
}

QUERIES = {f.__name__: f for f in (patients, admissions, icd_rollup, cohort_metadata, service_timeline, transfer_ordinal, transfer_timeline, unit_assignment, notes_with_unit, restricted_metadata, annotation_metadata, model_table, domain_cohort, prepared_model_data, patient_split, hashed_split, kfold, grouped_fold, resample, learning_curve, constrained_resample, sampled_rows, per_keyword_cap, block_sample)}
