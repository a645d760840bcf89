"""Gold report queries (G1-G5) and the SQL-surface twin."""

from __future__ import annotations

from carelake.oracle import reports_sql
from carelake.functions import fhir
from pyspark.sql import functions as F

from carelake.plans import claims_by_patient, ed_utilization, provider_claims, readmission_helper, weekly_facility
from carelake.plans.model import Model


def provider_claims_denial_monthly(spark, sf_dir):
    m = Model(spark, sf_dir)
    return provider_claims.build(spark, m.sources("claim", "organization"))["provider_claims_denial_monthly"]


def provider_claims_sql(spark, sf_dir):
    m = Model(spark, sf_dir)
    return provider_claims.spark_sql(spark, m.sources("claim", "organization"))


#: What the facility report reads of encounters and claims, each once.
WEEKLY = {
    "encounter": ("encounter_id", "patient_id", "organization_id", "class_code", "start_ts", "end_ts"),
    "claim": ("claim_id", "encounter_id", "patient_id", "provider_id", "billable_start", "total_value"),
}


def weekly_facility_report(spark, sf_dir):
    m = Model(spark, sf_dir)
    srcs = m.sources("organization", "patient", once=WEEKLY)
    return weekly_facility.build(spark, srcs)["weekly_facility_report"]


def readmissions_30d(spark, sf_dir):
    """The claim-row lag and its 30-day readmission flag."""
    m = Model(spark, sf_dir)
    s = m.sources("organization", "patient", once=WEEKLY)
    rows = weekly_facility.readmission_rows(s["encounter"], s["claim"], s["organization"], s["patient"])
    return rows.select(
        "encounter_id", "claim_id", "patient_id",
        fhir.to_ntz("enc_start_ts").alias("enc_start_ts"),
        fhir.to_ntz("prev_enc_end_ts").alias("prev_enc_end_ts"),
        "prev_is_inpatient", "is_readmission_30d",
    )


ED_SOURCES = ("organization", "patient")
#: What the ED reports read: encounters twice, claims and conditions once.
ED_ENCOUNTER = ("encounter_id", "patient_id", "organization_id", "class_code", "start_ts", "end_ts")
ED_CLAIM = ("encounter_id", "total_value")
ED_CONDITION = ("condition_id", "encounter_id", "code")


def _ed_sources(m: Model) -> dict:
    return m.sources(*ED_SOURCES, once={"claim": ED_CLAIM, "condition": ED_CONDITION}) | {"encounter": m.silver("encounter", *ED_ENCOUNTER)}


def ed_utilization_monthly(spark, sf_dir):
    m = Model(spark, sf_dir)
    return ed_utilization.build(spark, _ed_sources(m))["ed_utilization_monthly"]


def ed_admissions_24h(spark, sf_dir):
    """J6 + A4: ED visits flagged when an inpatient stay starts within 24 h."""
    m = Model(spark, sf_dir)
    s = _ed_sources(m)
    seen = ed_utilization.visits(s["encounter"], s["claim"], s["organization"], s["patient"])
    return seen.select(
        F.col("encounter_id").alias("enc_id"), F.col("patient_id").alias("enc_patient_id"), "facility_id", "month_start",
        fhir.to_ntz("start_ts").alias("period_start_ts"), F.col("admitted").alias("admit_from_ed_flag"),
    )


def top_condition(spark, sf_dir):
    """Most frequent condition per facility-month of ED visits."""
    m = Model(spark, sf_dir)
    s = _ed_sources(m)
    seen = ed_utilization.visits(s["encounter"], s["claim"], s["organization"], s["patient"])
    return ed_utilization.by_facility_month(seen, s["condition"]).select(*ed_utilization.GRAIN, "top_condition")


def claims_per_encounter(spark, sf_dir):
    m = Model(spark, sf_dir)
    out = ed_utilization.billed_per_encounter(m.silver("claim"))
    return out.select(F.col("encounter_id").alias("enc_id"), F.col("billed").cast("double").alias("encounter_claim_total"), F.col("n_claims").alias("claims_linked_count"))


def conditions_per_encounter(spark, sf_dir):
    """Every encounter with its condition count (0 when none)."""
    m = Model(spark, sf_dir)
    counts = ed_utilization.codes_per_encounter(m.silver("condition"))
    j = m.silver("encounter").select("encounter_id").join(counts, "encounter_id", "left")
    return j.select("encounter_id", F.coalesce("n_conditions", F.lit(0)).alias("cond_count_enc"))


def rejected_claim_counts(spark, sf_dir):
    m = Model(spark, sf_dir)
    return claims_by_patient.rejected_claim_counts(m.silver("claim"), m.silver("patient"))


def denied_claims_summary(spark, sf_dir):
    m = Model(spark, sf_dir)
    return claims_by_patient.build(spark, m.sources("claim", "patient"))["gold_rejected_claims_patient_summary_v2"]


def denied_claims_usd(spark, sf_dir):
    m = Model(spark, sf_dir)
    return claims_by_patient.denied_claims_usd(m.silver("claim"), m.silver("patient"))


#: What the readmission helper reads, each once.
READMISSION = {"encounter": ("encounter_id", "patient_ref", "class_code", "period_start"), "condition": ("patient_ref", "display")}


def readmission_monthly(spark, sf_dir):
    m = Model(spark, sf_dir)
    return readmission_helper.build(spark, m.sources(once=READMISSION))["readmission_risk_monthly"]


def expect_or_drop(spark, sf_dir):
    """Expectation 'not_null_patient_id' over claims -> kept / dropped counts."""
    m = Model(spark, sf_dir)
    rules = {"not_null_patient_id": "patient_id IS NOT NULL"}
    return claims_by_patient.expectation_counts(m.silver("claim"), rules)


QUERIES = {
    "rejected_claim_counts": rejected_claim_counts,
    "denied_claims_summary": denied_claims_summary,
    "denied_claims_usd": denied_claims_usd,
    "readmission_monthly": readmission_monthly,
    "expect_or_drop": expect_or_drop,
    "ed_utilization_monthly": ed_utilization_monthly,
    "ed_admissions_24h": ed_admissions_24h,
    "top_condition": top_condition,
    "claims_per_encounter": claims_per_encounter,
    "conditions_per_encounter": conditions_per_encounter,
    "weekly_facility_report": weekly_facility_report,
    "readmissions_30d": readmissions_30d,
    "provider_claims_denial_monthly": provider_claims_denial_monthly,
    "provider_claims_sql": provider_claims_sql,
}
ORACLES = {
    "rejected_claim_counts": reports_sql.REJECTED_CLAIM_COUNTS,
    "denied_claims_summary": reports_sql.DENIED_CLAIMS_SUMMARY,
    "denied_claims_usd": reports_sql.DENIED_CLAIMS_USD,
    "readmission_monthly": reports_sql.READMISSION_MONTHLY,
    "expect_or_drop": reports_sql.EXPECT_OR_DROP,
    "ed_utilization_monthly": reports_sql.ED_UTILIZATION,
    "ed_admissions_24h": reports_sql.ED_ADMISSIONS_24H,
    "top_condition": reports_sql.TOP_CONDITION,
    "claims_per_encounter": reports_sql.CLAIMS_PER_ENCOUNTER,
    "conditions_per_encounter": reports_sql.CONDITIONS_PER_ENCOUNTER,
    "weekly_facility_report": reports_sql.WEEKLY_FACILITY,
    "readmissions_30d": reports_sql.READMISSIONS_30D,
    "provider_claims_denial_monthly": reports_sql.PROVIDER_CLAIMS,
    "provider_claims_sql": reports_sql.PROVIDER_CLAIMS,
}
