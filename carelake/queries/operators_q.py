"""Single-operator queries of SURVEY §2.1-2.7 (scans, derived columns,
filters, joins, dedups), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import codes, fhir
from carelake.operators.skew_join import salted_join
from carelake.operators.dedup import latest_per_key
from carelake.oracle.base import with_ctes
from carelake.plans import claims_by_patient, provider_claims, weekly_facility
from carelake.plans.model import Model
from carelake.sources import bronze as bronze_mod
from carelake.sources.tables import Tables

RESOURCE_IDS = {
    "organization": ("Organization", "organization_id"),
    "practitioner": ("Practitioner", "practitioner_id"),
    "patient": ("Patient", "patient_id"),
    "encounter": ("Encounter", "encounter_id"),
    "condition": ("Condition", "condition_id"),
    "observation": ("Observation", "observation_id"),
    "procedure": ("Procedure", "procedure_id"),
    "claim": ("Claim", "claim_id"),
}


def _all_bronze(m: Model):
    return {r: m.bronze(r) for r in RESOURCE_IDS}


def bronze_ingest(spark, sf_dir):
    """Bronze rows of all resources (id / type / source columns), built
    by the ingest itself rather than read from the stored bronze tables."""
    m = Model(spark, sf_dir, stored=False)
    frames = [b.select("resource_id", "resource_type", "_source_file") for b in _all_bronze(m).values()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bronze_counts(spark, sf_dir):
    """Rows per resource type."""
    return bronze_mod.bronze_counts(_all_bronze(Model(spark, sf_dir)))


def bronze_preview(spark, sf_dir):
    """The first ten encounters by class and practitioner, parsed from bronze (a preview)."""
    shown = ["class_code", "practitioner_id", "encounter_id", "organization_id"]
    return bronze_mod.preview(Model(spark, sf_dir).parsed("encounter").select(*shown), shown, 10)


def reference_ids(spark, sf_dir):
    """Reference text -> id for every encounter reference."""
    e = Model(spark, sf_dir).silver("encounter")
    return e.select(
        "encounter_id", "patient_ref", fhir.ref_id("patient_ref").alias("patient_id"),
        "organization_ref", fhir.ref_id("organization_ref").alias("organization_id"),
    )


def parse_timestamps(spark, sf_dir):
    """D3: two-format billable start parse; junk -> null."""
    c = Model(spark, sf_dir).silver("claim")
    return c.select(
        "claim_id", "billable_start", fhir.to_ntz(fhir.parse_instant("billable_start")).alias("billable_start_ts")
    )


def length_of_stay(spark, sf_dir):
    """Inpatient flag and non-negative length of stay in days."""
    e = Model(spark, sf_dir).silver("encounter")
    return e.select(
        "encounter_id",
        fhir.is_inpatient("class_code").alias("is_inpatient"),
        fhir.length_of_stay_days("start_ts", "end_ts").alias("length_of_stay_days"),
    )


def weekly_buckets(spark, sf_dir):
    """Encounters per Monday week and per month (DATE buckets)."""
    e = Model(spark, sf_dir).silver("encounter")
    return e.groupBy(
        fhir.week_start("start_ts").alias("week_start"), fhir.month_start("start_ts").alias("month_start")
    ).agg(F.count(F.lit(1)).alias("encounter_count"))


def usd_amounts(spark, sf_dir):
    """USD-gated amount and null-as-zero billed amount."""
    c = Model(spark, sf_dir).once("claim", "claim_id", "total_value", "total_currency")
    return c.select(
        "claim_id", "total_value", "total_currency",
        fhir.usd_amount("total_value", "total_currency").alias("amount_usd"),
        F.coalesce("total_value", F.lit(0.0)).alias("billed_amount"),
    )


def patient_names(spark, sf_dir):
    """Display names (trimmed join; cleaned form c) and active flag."""
    p = Model(spark, sf_dir).silver("patient")
    return p.select(
        "patient_id",
        F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"),
        fhir.display_name("first_name", "last_name").alias("patient_name"),
        fhir.active_flag("active").alias("pat_active"),
    )


def claim_status_flags(spark, sf_dir):
    """Normalised status with denied/rejected and excluded flags, counted."""
    c = Model(spark, sf_dir).silver("claim")
    return c.groupBy(
        F.lower("status").alias("status_l"),
        fhir.denied_or_rejected("status").alias("is_denied_or_rejected"),
        fhir.excluded_status("status").alias("is_excluded_status"),
    ).agg(F.count(F.lit(1)).alias("claim_rows"))


def exclude_test_patients(spark, sf_dir):
    """patients kept by the narrow and by the wide test-name rule."""
    p = Model(spark, sf_dir).silver("patient")
    full = F.trim(F.concat_ws(" ", "first_name", "last_name"))
    return p.select(
        "patient_id",
        (~fhir.is_test_name(full)).alias("kept_narrow"),
        (~fhir.is_test_name(full, wide=True)).alias("kept_wide"),
    ).where(F.col("kept_narrow") | F.col("kept_wide"))


def encounter_claims(spark, sf_dir):
    """Encounter x claim inner join (multiplies by claim rows)."""
    m = Model(spark, sf_dir)
    j = m.silver("encounter").alias("e").join(m.silver("claim").alias("c"), "encounter_id")
    return j.select(
        "encounter_id", "claim_id",
        F.coalesce("c.patient_id", "e.patient_id").alias("patient_id"),
        F.coalesce("c.provider_id", "e.organization_id").alias("org_id"),
        fhir.week_start(F.coalesce(fhir.parse_instant("c.billable_start"), F.col("e.start_ts"))).alias("week_start"),
    )


def encounter_claims_skew(spark, sf_dir):
    """J1 with hot encounters spread: claims of an encounter that holds a large share of them are dealt to groups."""
    m = Model(spark, sf_dir)
    claims = m.silver("claim").select("encounter_id", "claim_id", "patient_id", "provider_id", "billable_start")
    visits = m.silver("encounter").select("encounter_id", F.col("patient_id").alias("e_patient_id"), "organization_id", "start_ts")
    return salted_join(claims, visits, "encounter_id").select(
        "encounter_id", "claim_id", F.coalesce("patient_id", "e_patient_id").alias("patient_id"), F.coalesce("provider_id", "organization_id").alias("org_id"),
        fhir.week_start(F.coalesce(fhir.parse_instant("billable_start"), F.col("start_ts"))).alias("week_start"),
    )


def facility_lookup(spark, sf_dir):
    """Claims -> organization dimension with defaults."""
    m = Model(spark, sf_dir)
    o = provider_claims.dedup_organizations(m.silver("organization")).select("organization_id", "org_name", "org_state")
    c = m.silver("claim").select("claim_id", "provider_id")
    from carelake.operators.joins import lookup

    j = lookup(c, o, "provider_id", "organization_id")
    return j.select(
        "claim_id", "provider_id",
        F.coalesce("org_name", F.lit(codes.UNKNOWN_PROVIDER_NAME)).alias("provider_name"),
        F.coalesce("org_state", F.lit(codes.UNKNOWN_PROVIDER_STATE)).alias("provider_state"),
    )


def dedup_claims_latest(spark, sf_dir):
    """One claim per claim_id (latest ingest, then status, then total)."""
    c = provider_claims.dedup_claims(Model(spark, sf_dir).silver("claim").select(*CLAIM_OUT))
    return c.select(*[fhir.to_ntz(x).alias(x) if x == "_ingested_at" else F.col(x) for x in CLAIM_OUT])


def dedup_patients_latest(spark, sf_dir):
    """One patient per patient_id (latest ingest)."""
    p = claims_by_patient.dedup_patients(Model(spark, sf_dir).silver("patient"))
    return p.select(*[fhir.to_ntz(x).alias(x) if x == "_ingested_at" else F.col(x) for x in p.columns])


def dedup_organizations(spark, sf_dir):
    """dropDuplicates(organization_id) with a deterministic winner."""
    o = provider_claims.dedup_organizations(Model(spark, sf_dir).silver("organization"))
    return o.select("organization_id", "npi", "org_name", "org_state")


def latest_per_key_q(spark, sf_dir):
    """Latest row per key over a log (latest event per user)."""
    ev = Tables(spark, sf_dir).events.select("user_id", "ts", "event_id", "event_type", "value")
    out = latest_per_key(ev, ["user_id"], ["ts", "event_id"])
    return out.select("user_id", F.col("ts").alias("latest_ts"), "event_id", "event_type", "value")


CLAIM_OUT = [
    "claim_id", "status", "patient_id", "provider_id", "encounter_id", "billable_start", "billable_end",
    "total_value", "total_currency", "_ingested_at",
]

QUERIES = {
    "bronze_ingest": bronze_ingest,
    "bronze_counts": bronze_counts,
    "bronze_preview": bronze_preview,
    "reference_ids": reference_ids,
    "parse_timestamps": parse_timestamps,
    "length_of_stay": length_of_stay,
    "weekly_buckets": weekly_buckets,
    "usd_amounts": usd_amounts,
    "patient_names": patient_names,
    "claim_status_flags": claim_status_flags,
    "exclude_test_patients": exclude_test_patients,
    "encounter_claims": encounter_claims,
    "encounter_claims_skew": encounter_claims_skew,
    "facility_lookup": facility_lookup,
    "dedup_claims_latest": dedup_claims_latest,
    "dedup_patients_latest": dedup_patients_latest,
    "dedup_organizations": dedup_organizations,
    "latest_per_key": latest_per_key_q,
}

_ALL = list(f"silver_{r}" for r in RESOURCE_IDS)
_UNION = " UNION ALL ".join(
    f"SELECT {col} AS resource_id, '{rt}' AS resource_type, '{rt}.ndjson' AS _source_file FROM silver_{r}"
    for r, (rt, col) in RESOURCE_IDS.items()
)
ORG_DEDUP = """(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY organization_id ORDER BY _ingested_at DESC NULLS LAST,
    npi DESC NULLS LAST, org_name DESC NULLS LAST, org_active DESC NULLS LAST, type_code DESC NULLS LAST,
    type_display DESC NULLS LAST, city DESC NULLS LAST, org_state DESC NULLS LAST, country DESC NULLS LAST,
    _source_file DESC NULLS LAST) AS rn FROM silver_organization) WHERE rn = 1)"""
NARROW = "regexp_matches(lower(COALESCE(trim(concat_ws(' ', first_name, last_name)), '')), '(^|\\s)(test|dummy)(\\s|$)')"
WIDE = "regexp_matches(lower(COALESCE(trim(concat_ws(' ', first_name, last_name)), '')), '(^|\\s)(test|dummy|demo|synthetic)($|\\s)')"

ORACLES = {
    "bronze_ingest": with_ctes(_ALL, _UNION),
    "bronze_counts": with_ctes(_ALL, f"SELECT resource_type, COUNT(*) AS row_count FROM ({_UNION}) GROUP BY 1"),
    "bronze_preview": with_ctes(
        ["silver_encounter"],
        """SELECT class_code, practitioner_id, encounter_id, organization_id FROM silver_encounter
           ORDER BY class_code NULLS FIRST, practitioner_id NULLS FIRST, encounter_id NULLS FIRST, organization_id NULLS FIRST LIMIT 10""",
    ),
    "reference_ids": with_ctes(
        ["silver_encounter"],
        "SELECT encounter_id, patient_ref, patient_id, organization_ref, organization_id FROM silver_encounter",
    ),
    "parse_timestamps": with_ctes(
        ["silver_claim"], "SELECT claim_id, billable_start, billable_start_ts FROM silver_claim"
    ),
    "length_of_stay": with_ctes(
        ["silver_encounter"],
        """SELECT encounter_id, CASE WHEN upper(class_code) = 'IMP' THEN 1 ELSE 0 END AS is_inpatient,
                  CASE WHEN start_ts IS NOT NULL AND end_ts IS NOT NULL
                       THEN greatest(datediff('day', start_ts, end_ts), 0) END AS length_of_stay_days
           FROM silver_encounter""",
    ),
    "weekly_buckets": with_ctes(
        ["silver_encounter"],
        """SELECT CAST(date_trunc('week', start_ts) AS DATE) AS week_start,
                  CAST(date_trunc('month', start_ts) AS DATE) AS month_start, COUNT(*) AS encounter_count
           FROM silver_encounter GROUP BY 1, 2""",
    ),
    "usd_amounts": with_ctes(
        ["silver_claim"],
        """SELECT claim_id, total_value, total_currency,
                  CASE WHEN total_currency = 'USD' THEN total_value END AS amount_usd,
                  COALESCE(total_value, 0.0) AS billed_amount
           FROM silver_claim""",
    ),
    "patient_names": with_ctes(
        ["silver_patient"],
        """SELECT patient_id, trim(concat_ws(' ', first_name, last_name)) AS full_name,
             regexp_replace(trim(COALESCE(concat_ws(' ', CASE WHEN trim(first_name) = '' THEN NULL ELSE first_name END,
                 CASE WHEN trim(last_name) = '' THEN NULL ELSE last_name END), '')), '\\s{2,}', ' ', 'g') AS patient_name,
             CASE WHEN lower(active) = 'false' THEN false ELSE true END AS pat_active
           FROM silver_patient""",
    ),
    "claim_status_flags": with_ctes(
        ["silver_claim"],
        """SELECT lower(status) AS status_l,
                  CASE WHEN lower(status) IN ('denied', 'rejected') THEN 1 ELSE 0 END AS is_denied_or_rejected,
                  CASE WHEN lower(status) IN ('cancelled', 'entered-in-error') THEN 1 ELSE 0 END AS is_excluded_status,
                  COUNT(*) AS claim_rows
           FROM silver_claim GROUP BY 1, 2, 3""",
    ),
    "exclude_test_patients": with_ctes(
        ["silver_patient"],
        f"""SELECT patient_id, NOT {NARROW} AS kept_narrow, NOT {WIDE} AS kept_wide FROM silver_patient
            WHERE NOT {NARROW} OR NOT {WIDE}""",
    ),
    "encounter_claims": with_ctes(
        ["silver_encounter", "silver_claim"],
        """SELECT e.encounter_id, c.claim_id, COALESCE(c.patient_id, e.patient_id) AS patient_id,
                  COALESCE(c.provider_id, e.organization_id) AS org_id,
                  CAST(COALESCE(date_trunc('week', c.billable_start_ts), date_trunc('week', e.start_ts)) AS DATE) AS week_start
           FROM silver_encounter e JOIN silver_claim c ON e.encounter_id = c.encounter_id""",
    ),
    "encounter_claims_skew": with_ctes(
        ["silver_encounter", "silver_claim"],
        """SELECT e.encounter_id, c.claim_id, COALESCE(c.patient_id, e.patient_id) AS patient_id,
                  COALESCE(c.provider_id, e.organization_id) AS org_id,
                  CAST(COALESCE(date_trunc('week', c.billable_start_ts), date_trunc('week', e.start_ts)) AS DATE) AS week_start
           FROM silver_claim c JOIN silver_encounter e USING (encounter_id)""",
    ),
    "facility_lookup": with_ctes(
        ["silver_claim", "silver_organization"],
        f"""SELECT c.claim_id, c.provider_id, COALESCE(o.org_name, 'Unknown provider') AS provider_name,
                   COALESCE(o.org_state, 'Unknown') AS provider_state
            FROM silver_claim c LEFT JOIN {ORG_DEDUP} o ON c.provider_id = o.organization_id""",
    ),
    "dedup_claims_latest": with_ctes(
        ["silver_claim"],
        """SELECT claim_id, status, patient_id, provider_id, encounter_id, billable_start, billable_end, total_value,
                  total_currency, _ingested_at FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC NULLS LAST,
               status DESC NULLS LAST, total_value DESC NULLS LAST, patient_id DESC NULLS LAST,
               provider_id DESC NULLS LAST, encounter_id DESC NULLS LAST, billable_start DESC NULLS LAST,
               billable_end DESC NULLS LAST, total_currency DESC NULLS LAST) AS rn FROM silver_claim) WHERE rn = 1""",
    ),
    "dedup_patients_latest": with_ctes(
        ["silver_patient"],
        """SELECT patient_id, mrn, last_name, first_name, gender, birth_date, postal_code, state, active, _source_file,
                  _ingested_at FROM (
             SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY _ingested_at DESC NULLS LAST,
               mrn DESC NULLS LAST, last_name DESC NULLS LAST, first_name DESC NULLS LAST, gender DESC NULLS LAST,
               birth_date DESC NULLS LAST, postal_code DESC NULLS LAST, state DESC NULLS LAST,
               active DESC NULLS LAST, _source_file DESC NULLS LAST) AS rn FROM silver_patient) WHERE rn = 1""",
    ),
    "dedup_organizations": with_ctes(
        ["silver_organization"], f"SELECT organization_id, npi, org_name, org_state FROM {ORG_DEDUP}"
    ),
    "latest_per_key": """
        SELECT user_id, ts AS latest_ts, event_id, event_type, value FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST,
                                       event_type DESC NULLS LAST, value DESC NULLS LAST) AS rn
          FROM events) WHERE rn = 1""",
}
