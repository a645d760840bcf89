"""Silver-table queries (X1-X8): parse the FHIR JSON of every resource."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import fhir
from carelake.oracle.base import with_ctes
from carelake.plans.model import Model

SILVER_COLUMNS = {
    "claim": [
        "claim_id", "status", "claim_type", "patient_id", "provider_id", "encounter_id", "billable_start",
        "billable_end", "total_value", "total_currency", "_source_file", "_ingested_at",
    ],
    "patient": [
        "patient_id", "mrn", "last_name", "first_name", "gender", "birth_date", "postal_code", "state", "active",
        "_source_file", "_ingested_at",
    ],
    "organization": [
        "organization_id", "npi", "org_name", "org_active", "type_code", "type_display", "city", "org_state",
        "country", "_source_file", "_ingested_at",
    ],
    "encounter": [
        "encounter_id", "status", "class_system", "class_code", "patient_ref", "patient_id", "practitioner_id",
        "organization_ref", "organization_id", "period_start", "period_end", "reason_code", "start_ts", "end_ts",
        "_source_file", "_ingested_at",
    ],
    "condition": [
        "condition_id", "clinical_status", "code_system", "code", "display", "patient_id", "encounter_id", "onset",
        "_source_file", "_ingested_at",
    ],
    "observation": [
        "observation_id", "status", "code", "display", "patient_id", "encounter_id", "effective", "value", "unit",
        "_source_file", "_ingested_at",
    ],
    "procedure": [
        "procedure_id", "status", "code", "display", "patient_id", "encounter_id", "performed", "_source_file",
        "_ingested_at",
    ],
    "practitioner": ["practitioner_id", "npi", "last_name", "first_name", "active", "_source_file", "_ingested_at"],
}

TIMESTAMP_COLUMNS = {"start_ts", "end_ts", "_ingested_at"}


def _silver_query(resource: str):
    def run(spark, sf_dir):
        # the parse itself (bronze table -> from_json), not the stored silver table
        df = Model(spark, sf_dir).parsed(resource)
        return df.select(
            *[fhir.to_ntz(c).alias(c) if c in TIMESTAMP_COLUMNS else F.col(c) for c in SILVER_COLUMNS[resource]]
        )

    return run


QUERIES = {f"silver_{r}": _silver_query(r) for r in SILVER_COLUMNS}
ORACLES = {
    f"silver_{r}": with_ctes([f"silver_{r}"], f"SELECT {', '.join(cols)} FROM silver_{r}")
    for r, cols in SILVER_COLUMNS.items()
}
