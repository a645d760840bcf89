"""Provider x month claims and denials.

Rules: claims deduplicated by claim_id (latest ``_ingested_at``, then status,
then total, all DESC NULLS LAST) BEFORE the status exclusion; month from the
billable start (ISO or MM/dd/yyyy HH:mm; unparsable rows dropped); statuses
compared lower-case; provider defaults 'Unknown provider' / 'Unknown'; null
totals count as 0 and negatives are summed as they are.

Plan shape: one aggregation for the dedup (partial, skew-safe), a lookup to
the organization dimension (broadcast only if its size estimate is small),
one aggregation for the grain. ``count(claim_id)`` equals the reference's
``countDistinct`` because claim_id is unique after the dedup, and avoids the
distinct-expand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.functions import codes, fhir
from carelake.operators.dedup import latest_per_key
from carelake.operators.joins import lookup

CLAIM_ORDER = ["_ingested_at", "status", "total_value"]
GRAIN = ["provider_id", "provider_name", "provider_state", "claim_month"]
OUTPUT = GRAIN + ["claims_count", "amount_billed", "denied_or_rejected_claims_count", "denial_rate"]


def claim_month(billable_start) -> F.Column:
    ts = fhir.parse_instant(billable_start)  # ISO first, as D4 writes it; same result
    return F.date_trunc("month", ts).cast("date")


def dedup_claims(claim: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns) if columns else [c for c in claim.columns]
    return latest_per_key(claim.select(*cols), ["claim_id"], CLAIM_ORDER)


def dedup_organizations(org: DataFrame) -> DataFrame:
    """dropDuplicates(organization_id) made deterministic."""
    return latest_per_key(org, ["organization_id"], ["_ingested_at"])


def build(spark: SparkSession, sources: dict, excluded_statuses=None) -> dict:
    claim = sources["claim"]
    org = sources["organization"]
    claim_cols = [
        "claim_id", "status", "patient_id", "provider_id", "encounter_id", "billable_start", "billable_end",
        "total_value", "total_currency", "_ingested_at",
    ]
    c = dedup_claims(claim, [x for x in claim_cols if x in claim.columns])
    c = (
        c.withColumn("claim_month", claim_month(F.col("billable_start")))
        .where(F.col("claim_month").isNotNull())
        .where(fhir.excluded_status("status", excluded_statuses) == 0)
        .select(
            "claim_id", "provider_id", "claim_month",
            F.coalesce(F.col("total_value"), F.lit(0.0)).alias("billed_amount"),
            fhir.denied_or_rejected("status").alias("is_denied_or_rejected"),
        )
    )
    o = dedup_organizations(org).select("organization_id", "org_name", "org_state")
    joined = lookup(c, o, "provider_id", "organization_id").select(
        "provider_id",
        F.coalesce("org_name", F.lit(codes.UNKNOWN_PROVIDER_NAME)).alias("provider_name"),
        F.coalesce("org_state", F.lit(codes.UNKNOWN_PROVIDER_STATE)).alias("provider_state"),
        "claim_month", "claim_id", "billed_amount", "is_denied_or_rejected",
    )
    agg = joined.groupBy(*GRAIN).agg(
        F.count("claim_id").alias("claims_count"),
        F.sum(F.col("billed_amount").try_cast("decimal(18,2)")).alias("amount_sum"),
        F.sum("is_denied_or_rejected").cast("long").alias("denied_or_rejected_claims_count"),
    )
    result = agg.select(
        *GRAIN,
        "claims_count",
        F.col("amount_sum").try_cast("decimal(18,2)").alias("amount_billed"),
        "denied_or_rejected_claims_count",
        fhir.guarded_ratio("denied_or_rejected_claims_count", "claims_count").alias("denial_rate"),
    ).where(F.col("provider_id").isNotNull() & F.col("claim_month").isNotNull())
    return {"provider_claims_denial_monthly": result}


SQL_TEMPLATE = """
WITH ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC NULLS LAST,
         status DESC NULLS LAST, total_value DESC NULLS LAST, patient_id DESC NULLS LAST,
         provider_id DESC NULLS LAST, encounter_id DESC NULLS LAST, billable_start DESC NULLS LAST,
         billable_end DESC NULLS LAST, total_currency DESC NULLS LAST) AS rn
  FROM {claim}
), c AS (
  SELECT claim_id, provider_id, lower(status) AS status_l, total_value,
         CAST(date_trunc('month', COALESCE(TRY_TO_TIMESTAMP(billable_start),
              TRY_TO_TIMESTAMP(billable_start, 'MM/dd/yyyy HH:mm'))) AS DATE) AS claim_month
  FROM ranked WHERE rn = 1
), o AS (
  SELECT organization_id, org_name, org_state FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY organization_id ORDER BY _ingested_at DESC NULLS LAST,
           npi DESC NULLS LAST, org_name DESC NULLS LAST, org_active DESC NULLS LAST, type_code DESC NULLS LAST,
           type_display DESC NULLS LAST, city DESC NULLS LAST, org_state DESC NULLS LAST, country DESC NULLS LAST,
           _source_file DESC NULLS LAST) AS rn FROM {organization}) WHERE rn = 1
)
SELECT c.provider_id, COALESCE(o.org_name, 'Unknown provider') AS provider_name,
       COALESCE(o.org_state, 'Unknown') AS provider_state, c.claim_month,
       COUNT(c.claim_id) AS claims_count,
       CAST(SUM(CAST(COALESCE(c.total_value, 0.0) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount_billed,
       SUM(CASE WHEN c.status_l IN ('denied','rejected') THEN 1 ELSE 0 END) AS denied_or_rejected_claims_count,
       ROUND(CASE WHEN COUNT(c.claim_id) > 0 THEN SUM(CASE WHEN c.status_l IN ('denied','rejected') THEN 1 ELSE 0 END)
             / CAST(COUNT(c.claim_id) AS DOUBLE) ELSE 0.0 END, 6) AS denial_rate
FROM c LEFT JOIN o ON c.provider_id = o.organization_id
WHERE c.claim_month IS NOT NULL AND COALESCE(c.status_l, '') NOT IN ({excluded})
  AND c.provider_id IS NOT NULL
GROUP BY 1, 2, 3, 4
"""


def spark_sql(spark: SparkSession, sources: dict, excluded_statuses=None) -> DataFrame:
    """The same report as SQL text over the frames (SQL twin). A claim without a status is kept."""
    excluded = codes.EXCLUDED_CLAIM_STATUSES if excluded_statuses is None else excluded_statuses
    listed = ", ".join("'" + s.lower().replace("'", "''") + "'" for s in excluded) or "NULL"
    return spark.sql(SQL_TEMPLATE.replace("{excluded}", listed), claim=sources["claim"], organization=sources["organization"])
