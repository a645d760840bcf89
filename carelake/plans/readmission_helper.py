"""Monthly encounter x condition helper.

Reference semantics: encounters and conditions joined many-to-many on the
patient id ('Patient/' stripped), grouped by (encounter month, condition
display, encounter class) -> count(encounter_id) over the joined pairs and
count(distinct patient). Null displays and unparsable months are groups of
their own (H18).

The pairs are never materialised: each side is first aggregated per patient
((month, class) -> encounter count; display -> condition count), the
aggregates are joined on the patient, and the pair count is the product.
Per patient the join emits (#months x #classes) x #displays rows, which is
bounded by calendar and code-list sizes, not by how many rows the patient
has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions import fhir


def build(spark: SparkSession, sources: dict) -> dict:
    enc, cond = sources["encounter"], sources["condition"]
    e = (
        enc.select(
            fhir.strip_prefix("patient_ref", "Patient/").alias("patient_id"),
            "encounter_id",
            F.col("class_code").alias("encounter_class"),
            F.date_trunc("month", fhir.parse_iso("period_start")).cast("date").alias("month"),
        )
        .where(F.col("patient_id").isNotNull())
        .groupBy("patient_id", "month", "encounter_class")
        .agg(F.count("encounter_id").alias("n_enc"))
    )
    c = (
        cond.select(fhir.strip_prefix("patient_ref", "Patient/").alias("patient_id"), F.col("display").alias("condition_name"))
        .where(F.col("patient_id").isNotNull())
        .groupBy("patient_id", "condition_name")
        .agg(F.count(F.lit(1)).alias("n_cond"))
    )
    # the joined rows are unique by patient within a group, so a count is the distinct count
    pairs = e.join(c, "patient_id", "inner")
    out = pairs.groupBy("month", "condition_name", "encounter_class").agg(
        F.sum(F.col("n_enc") * F.col("n_cond")).cast("long").alias("encounter_count"),
        F.count(F.lit(1)).alias("unique_patients"),
    )
    return {"readmission_risk_monthly": out}
