"""G4a/b/c: three different per-patient claim summaries (never merged).

* G4a ``rejected_claim_counts`` (locked acceptance suite): status exactly
  'rejected', rows counted (duplicates count), claims need a known patient
  (semi-join to the patient ids, so duplicate patient rows do not multiply).
* G4b ``denied_claims_summary``: lower(status) = 'denied', no claim dedup;
  active patients deduplicated by patient_id after the active filter; name
  cleaned (D19c); last denial date; row count; decimal amount.
* G4c ``denied_claims_usd``: claims and patients deduplicated by latest
  ``_ingested_at`` BEFORE the denied/active filters; USD-only amount; distinct
  claims; most recent billable start.

All three aggregate claims per patient; claim-side partial aggregation runs
before any shuffle, so a patient with a huge share of claims is reduced
map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions import fhir
from carelake.operators.dedup import latest_per_key
from carelake.plans.silver import CLAIM_COLUMNS, PATIENT_COLUMNS


def rejected_claim_counts(claim: DataFrame, patient: DataFrame) -> DataFrame:
    counts = (
        claim.where((F.col("status") == "rejected") & F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(F.count(F.lit(1)).alias("rejected_claim_count"))
    )
    known = patient.select("patient_id").where(F.col("patient_id").isNotNull())
    return counts.join(known, "patient_id", "left_semi")


def dedup_patients(patient: DataFrame) -> DataFrame:
    return latest_per_key(patient.select(*PATIENT_COLUMNS), ["patient_id"], ["_ingested_at"])


def denied_claims_summary(claim: DataFrame, patient: DataFrame) -> DataFrame:
    c = claim.where(F.col("patient_id").isNotNull() & (F.lower("status") == "denied"))
    c = c.select(
        "patient_id", "claim_id", "total_value",
        F.coalesce(
            F.try_to_timestamp("billable_start"),
            F.try_to_timestamp("billable_start", F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        ).try_cast("date").alias("billable_start_date"),
    )
    per_patient = c.groupBy("patient_id").agg(
        F.max("billable_start_date").alias("last_denial_date"),
        F.count("claim_id").alias("total_denied_claims"),
        F.sum(F.col("total_value").try_cast("decimal(18,2)")).alias("total_denied_amount"),
    )
    p = patient.where(F.lower("active") == "true")
    p = latest_per_key(p.select(*PATIENT_COLUMNS), ["patient_id"], ["_ingested_at"])
    p = p.select("patient_id", fhir.display_name("first_name", "last_name").alias("patient_name"), "gender", "state")
    # one patient row per id, so aggregating claims first and joining after is
    # the same as the reference's join-then-group (max over one row)
    return p.join(per_patient, "patient_id", "inner").select(
        "patient_id", "patient_name", "gender", "state", "last_denial_date", "total_denied_claims", "total_denied_amount"
    )


def denied_claims_usd(claim: DataFrame, patient: DataFrame) -> DataFrame:
    c = latest_per_key(claim.select(*CLAIM_COLUMNS).where(F.col("patient_id").isNotNull()), ["claim_id"], ["_ingested_at"])
    denied = c.where(F.lower("status") == "denied").select(
        "claim_id", "patient_id",
        fhir.parse_iso("billable_start").alias("billable_start_ts"),
        fhir.usd_amount("total_value", "total_currency").alias("amount_usd"),
    )
    p = dedup_patients(patient).where(F.lower("active") == "true").select("patient_id", "gender", "state")
    j = denied.join(p, "patient_id", "inner")
    agg = j.groupBy("patient_id", "gender", "state").agg(
        F.count("claim_id").alias("rejected_claim_count"),
        F.sum(F.col("amount_usd").try_cast("decimal(18,2)")).try_cast("decimal(18,2)").alias("total_rejected_amount"),
        F.max("billable_start_ts").alias("most_recent_rejection_date"),
    )
    return agg.select(
        "patient_id", "gender", "state", "rejected_claim_count", "total_rejected_amount",
        fhir.to_ntz("most_recent_rejection_date").alias("most_recent_rejection_date"),
    )


def expect_or_drop(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows passing every SQL rule, and the quarantine with the failed rule
    names. One pass: the failed-rule array is computed once per row."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    )
    tagged = df.withColumn("_failed_rules", failed)
    kept = tagged.where(F.size("_failed_rules") == 0).drop("_failed_rules")
    quarantine = tagged.where(F.size("_failed_rules") > 0)
    return kept, quarantine


def expectation_counts(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Per rule: rows passing and rows dropped, in one aggregation."""
    aggs = []
    for name, cond in rules.items():
        ok = F.coalesce(F.expr(cond), F.lit(False))
        aggs += [
            F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias(f"{name}__kept"),
            F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias(f"{name}__dropped"),
        ]
    wide = df.agg(*aggs)
    stacked = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}__kept").alias("kept_rows"), F.col(f"{n}__dropped").alias("dropped_rows")) for n in rules])
    )
    return wide.select(stacked.alias("r")).select("r.*")


def build(spark: SparkSession, sources: dict) -> dict:
    claim, patient = sources["claim"], sources["patient"]
    summary, _ = expect_or_drop(denied_claims_summary(claim, patient), {"not_null_patient_id": "patient_id IS NOT NULL"})
    return {
        "rejected_claim_counts": rejected_claim_counts(claim, patient),
        "gold_rejected_claims_patient_summary_v2": summary,
        "rejected_claims_patient_summary": denied_claims_usd(claim, patient),
    }
