"""DuckDB oracles of the gold reports, over the column-computed silver CTEs."""

from __future__ import annotations

from carelake.oracle.base import with_ctes

CLAIM_DEDUP = """
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC NULLS LAST,
           status DESC NULLS LAST, total_value DESC NULLS LAST, patient_id DESC NULLS LAST,
           provider_id DESC NULLS LAST, encounter_id DESC NULLS LAST, billable_start DESC NULLS LAST,
           billable_end DESC NULLS LAST, total_currency DESC NULLS LAST) AS rn
    FROM silver_claim) WHERE rn = 1
"""

ORG_DEDUP = """
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY organization_id ORDER BY _ingested_at DESC NULLS LAST,
           npi DESC NULLS LAST, org_name DESC NULLS LAST, org_active DESC NULLS LAST, type_code DESC NULLS LAST,
           type_display DESC NULLS LAST, city DESC NULLS LAST, org_state DESC NULLS LAST,
           country DESC NULLS LAST, _source_file DESC NULLS LAST) AS rn
    FROM silver_organization) WHERE rn = 1
"""

PROVIDER_CLAIMS = with_ctes(
    ["silver_claim", "silver_organization"],
    """
SELECT c.provider_id, COALESCE(o.org_name, 'Unknown provider') AS provider_name,
       COALESCE(o.org_state, 'Unknown') AS provider_state,
       CAST(date_trunc('month', c.billable_start_ts) AS DATE) AS claim_month,
       COUNT(c.claim_id) AS claims_count,
       CAST(SUM(CAST(COALESCE(c.total_value, 0.0) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount_billed,
       SUM(CASE WHEN lower(c.status) IN ('denied','rejected') THEN 1 ELSE 0 END) AS denied_or_rejected_claims_count,
       ROUND(SUM(CASE WHEN lower(c.status) IN ('denied','rejected') THEN 1 ELSE 0 END)
             / CAST(COUNT(c.claim_id) AS DOUBLE), 6) AS denial_rate
FROM claim_dedup c LEFT JOIN org_dedup o ON c.provider_id = o.organization_id
WHERE c.billable_start_ts IS NOT NULL AND (c.status IS NULL OR lower(c.status) NOT IN ('cancelled','entered-in-error'))
  AND c.provider_id IS NOT NULL
GROUP BY 1, 2, 3, 4
""",
    extra=[("claim_dedup", CLAIM_DEDUP), ("org_dedup", ORG_DEDUP)],
)

WEEKLY_ROWS = """
  SELECT e.encounter_id, c.claim_id,
         COALESCE(c.patient_id, e.patient_id) AS patient_id,
         COALESCE(c.provider_id, e.organization_id) AS org_id,
         e.start_ts AS enc_start_ts, e.end_ts AS enc_end_ts,
         CASE WHEN upper(e.class_code) = 'IMP' THEN 1 ELSE 0 END AS is_inpatient,
         CASE WHEN e.start_ts IS NOT NULL AND e.end_ts IS NOT NULL
              THEN greatest(datediff('day', e.start_ts, e.end_ts), 0) END AS length_of_stay_days,
         COALESCE(date_trunc('week', c.billable_start_ts), date_trunc('week', e.start_ts)) AS week_start,
         c.total_value AS billed_amount, COALESCE(c.total_value, 0.0) AS paid_amount
  FROM silver_encounter e JOIN silver_claim c ON e.encounter_id = c.encounter_id
"""

REAL_PATIENTS = """
  SELECT patient_id FROM silver_patient
  WHERE NOT regexp_matches(lower(COALESCE(trim(concat_ws(' ', first_name, last_name)), '')),
                           '(^|\\s)(test|dummy)(\\s|$)')
"""

WEEKLY_LAGGED = """
  SELECT r.*, o.org_name,
    LAG(enc_end_ts) OVER w AS prev_enc_end_ts, LAG(is_inpatient) OVER w AS prev_is_inpatient
  FROM weekly_rows r
  LEFT JOIN silver_organization o ON r.org_id = o.organization_id
  JOIN real_patients p ON r.patient_id = p.patient_id
  WINDOW w AS (PARTITION BY r.patient_id ORDER BY enc_start_ts ASC NULLS FIRST, encounter_id ASC NULLS FIRST,
               claim_id ASC NULLS FIRST, org_id ASC NULLS FIRST, week_start ASC NULLS FIRST,
               billed_amount ASC NULLS FIRST)
"""

WEEKLY_FLAGGED = """
  SELECT *, CASE WHEN prev_is_inpatient = 1 AND prev_enc_end_ts IS NOT NULL AND enc_start_ts IS NOT NULL
                  AND datediff('day', prev_enc_end_ts, enc_start_ts) BETWEEN 0 AND 30 THEN 1 ELSE 0 END
              AS is_readmission_30d
  FROM weekly_lagged
"""

WEEKLY_FACILITY = with_ctes(
    ["silver_encounter", "silver_claim", "silver_organization", "silver_patient"],
    """
SELECT org_id AS facility_id, org_name AS facility_name, CAST(week_start AS DATE) AS week_start,
       COUNT(*) AS encounter_count,
       ROUND(SUM(is_readmission_30d) / CAST(COUNT(*) AS DOUBLE), 6) AS readmission_rate,
       CAST(SUM(CAST(billed_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_billed_amount,
       CAST(SUM(CAST(paid_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_paid_amount,
       ROUND(AVG(CASE WHEN is_inpatient = 1 THEN length_of_stay_days END), 6) AS average_length_of_stay
FROM weekly_flagged
GROUP BY 1, 2, 3
""",
    extra=[("weekly_rows", WEEKLY_ROWS), ("real_patients", REAL_PATIENTS), ("weekly_lagged", WEEKLY_LAGGED),
           ("weekly_flagged", WEEKLY_FLAGGED)],
)

READMISSIONS_30D = with_ctes(
    ["silver_encounter", "silver_claim", "silver_organization", "silver_patient"],
    """
SELECT encounter_id, claim_id, patient_id, CAST(enc_start_ts AS TIMESTAMP) AS enc_start_ts,
       CAST(prev_enc_end_ts AS TIMESTAMP) AS prev_enc_end_ts, prev_is_inpatient, is_readmission_30d
FROM weekly_flagged
""",
    extra=[("weekly_rows", WEEKLY_ROWS), ("real_patients", REAL_PATIENTS), ("weekly_lagged", WEEKLY_LAGGED),
           ("weekly_flagged", WEEKLY_FLAGGED)],
)

ED_BASE = [
    ("billed", """
  SELECT encounter_id AS enc_id, SUM(CAST(COALESCE(total_value, 0.0) AS DECIMAL(18,2))) AS encounter_claim_total,
         COUNT(*) AS claims_linked_count
  FROM silver_claim WHERE encounter_id IS NOT NULL GROUP BY 1
"""),
    ("people", """
  SELECT patient_id AS person,
         CASE WHEN lower(active) = 'true' THEN true WHEN lower(active) = 'false' THEN false ELSE true END AS is_active,
         regexp_matches(lower(concat_ws(' ', first_name, last_name)), '(^|\\s)(test|dummy|demo|synthetic)($|\\s)')
           AS is_test_name
  FROM silver_patient
"""),
    ("emergency", """
  SELECT e.encounter_id AS enc_id, e.patient_id AS enc_patient_id, e.organization_id AS facility_id,
         COALESCE(o.org_name, e.organization_id) AS facility_name, e.start_ts AS period_start_ts,
         e.end_ts AS period_end_ts, CAST(date_trunc('month', e.start_ts) AS DATE) AS month_start,
         c.encounter_claim_total, c.claims_linked_count
  FROM silver_encounter e
  JOIN billed c ON e.encounter_id = c.enc_id
  LEFT JOIN silver_organization o ON e.organization_id = o.organization_id
  LEFT JOIN people p ON e.patient_id = p.person
  WHERE e.class_code = 'EMER' AND e.start_ts IS NOT NULL
    AND COALESCE(p.is_active, true) = true AND COALESCE(p.is_test_name, false) = false
"""),
    ("visits", """
  SELECT ed.enc_id, ed.facility_id, ed.facility_name, ed.month_start, ed.enc_patient_id, ed.encounter_claim_total,
         ed.claims_linked_count, ed.period_start_ts, ed.period_end_ts,
         MAX(CASE WHEN stay.encounter_id IS NOT NULL THEN 1 ELSE 0 END) AS admit_from_ed_flag
  FROM emergency ed LEFT JOIN silver_encounter stay
    ON ed.enc_patient_id = stay.patient_id AND stay.class_code = 'IMP' AND stay.start_ts IS NOT NULL
   AND ed.period_start_ts IS NOT NULL AND stay.start_ts >= ed.period_start_ts
   AND stay.start_ts <= ed.period_start_ts + INTERVAL 24 HOURS
  GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9
"""),
    ("condition_counts", "SELECT encounter_id AS enc_id, COUNT(condition_id) AS cond_count_enc FROM silver_condition GROUP BY 1"),
    ("visited", """
  SELECT visits.*, COALESCE(n.cond_count_enc, 0) AS cond_count_enc FROM visits LEFT JOIN condition_counts n ON visits.enc_id = n.enc_id
"""),
    ("leading_codes", """
  SELECT facility_id, facility_name, month_start,
         CASE WHEN cond_code = 'UNKNOWN' THEN NULL ELSE cond_code END AS top_condition
  FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY facility_id, facility_name, month_start
                                 ORDER BY cond_freq DESC, cond_code ASC) AS rn
    FROM (
      SELECT a.facility_id, a.facility_name, a.month_start, COALESCE(c.code, 'UNKNOWN') AS cond_code,
             COUNT(*) AS cond_freq
      FROM visited a LEFT JOIN silver_condition c ON a.enc_id = c.encounter_id
      GROUP BY a.facility_id, a.facility_name, a.month_start, c.code))
  WHERE rn = 1
"""),
]
ED_DEPS = ["silver_encounter", "silver_claim", "silver_organization", "silver_patient", "silver_condition"]

ED_UTILIZATION = with_ctes(
    ED_DEPS,
    """
SELECT metrics.*, leader.top_condition FROM (
  SELECT facility_id, facility_name, month_start, COUNT(*) AS ed_visit_count,
         COUNT(DISTINCT enc_patient_id) AS unique_patients,
         ROUND(CAST(AVG(encounter_claim_total) AS DOUBLE), 6) AS avg_claim_amount,
         CAST(SUM(encounter_claim_total) AS DOUBLE) AS total_billed,
         SUM(admit_from_ed_flag) AS admits_from_ed,
         ROUND(AVG(CAST(cond_count_enc AS DOUBLE)), 6) AS avg_conditions_per_visit
  FROM visited GROUP BY 1, 2, 3) metrics
LEFT JOIN leading_codes leader ON metrics.facility_id = leader.facility_id AND metrics.facility_name = leader.facility_name
                 AND metrics.month_start = leader.month_start
""",
    extra=ED_BASE,
)

ED_ADMISSIONS_24H = with_ctes(
    ED_DEPS,
    """
SELECT enc_id, enc_patient_id, facility_id, month_start, CAST(period_start_ts AS TIMESTAMP) AS period_start_ts,
       admit_from_ed_flag
FROM visits
""",
    extra=ED_BASE,
)

TOP_CONDITION = with_ctes(ED_DEPS, "SELECT * FROM leading_codes", extra=ED_BASE)

CLAIMS_PER_ENCOUNTER = with_ctes(
    ["silver_claim"],
    """
SELECT encounter_id AS enc_id, CAST(SUM(CAST(COALESCE(total_value, 0.0) AS DECIMAL(18,2))) AS DOUBLE)
         AS encounter_claim_total, COUNT(*) AS claims_linked_count
FROM silver_claim WHERE encounter_id IS NOT NULL GROUP BY 1
""",
)

CONDITIONS_PER_ENCOUNTER = with_ctes(
    ["silver_encounter", "silver_condition"],
    """
SELECT e.encounter_id, COALESCE(cc.cond_count_enc, 0) AS cond_count_enc
FROM silver_encounter e
LEFT JOIN (SELECT encounter_id, COUNT(condition_id) AS cond_count_enc FROM silver_condition GROUP BY 1) cc
  ON e.encounter_id = cc.encounter_id
""",
)

REJECTED_CLAIM_COUNTS = with_ctes(
    ["silver_claim", "silver_patient"],
    """
SELECT c.patient_id, COUNT(*) AS rejected_claim_count
FROM silver_claim c
WHERE c.status = 'rejected' AND c.patient_id IS NOT NULL
  AND c.patient_id IN (SELECT patient_id FROM silver_patient WHERE patient_id IS NOT NULL)
GROUP BY 1
""",
)

PATIENT_ORDER = """_ingested_at DESC NULLS LAST, mrn DESC NULLS LAST, last_name DESC NULLS LAST,
  first_name DESC NULLS LAST, gender DESC NULLS LAST, birth_date DESC NULLS LAST, postal_code DESC NULLS LAST,
  state DESC NULLS LAST, active DESC NULLS LAST, _source_file DESC NULLS LAST"""

DENIED_CLAIMS_SUMMARY = with_ctes(
    ["silver_claim", "silver_patient"],
    f"""
SELECT p.patient_id,
  regexp_replace(trim(COALESCE(concat_ws(' ', CASE WHEN trim(p.first_name) = '' THEN NULL ELSE p.first_name END,
                                              CASE WHEN trim(p.last_name) = '' THEN NULL ELSE p.last_name END), '')),
                 '\\s{{2,}}', ' ', 'g') AS patient_name,
  p.gender, p.state,
  MAX(CAST(c.billable_start_iso_ts AS DATE)) AS last_denial_date,
  COUNT(c.claim_id) AS total_denied_claims,
  SUM(CAST(c.total_value AS DECIMAL(18,2))) AS total_denied_amount
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY {PATIENT_ORDER}) AS rn
                     FROM silver_patient WHERE lower(active) = 'true') WHERE rn = 1) p
JOIN silver_claim c ON p.patient_id = c.patient_id
WHERE c.patient_id IS NOT NULL AND lower(c.status) = 'denied'
GROUP BY p.patient_id, p.first_name, p.last_name, p.gender, p.state
""",
)

DENIED_CLAIMS_USD = with_ctes(
    ["silver_claim", "silver_patient"],
    f"""
SELECT p.patient_id, p.gender, p.state, COUNT(DISTINCT c.claim_id) AS rejected_claim_count,
  CAST(SUM(CASE WHEN c.total_currency = 'USD' THEN CAST(c.total_value AS DECIMAL(18,2)) END) AS DECIMAL(18,2))
    AS total_rejected_amount,
  MAX(c.billable_start_iso_ts) AS most_recent_rejection_date
FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC NULLS LAST,
        status DESC NULLS LAST, claim_type DESC NULLS LAST, patient_id DESC NULLS LAST, provider_id DESC NULLS LAST,
        encounter_id DESC NULLS LAST, billable_start DESC NULLS LAST, billable_end DESC NULLS LAST,
        total_value DESC NULLS LAST, total_currency DESC NULLS LAST, _source_file DESC NULLS LAST) AS rn
      FROM silver_claim WHERE patient_id IS NOT NULL) WHERE rn = 1) c
JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY patient_id ORDER BY {PATIENT_ORDER}) AS rn
      FROM silver_patient) WHERE rn = 1) p ON c.patient_id = p.patient_id
WHERE lower(c.status) = 'denied' AND lower(p.active) = 'true'
GROUP BY 1, 2, 3
""",
)

READMISSION_MONTHLY = with_ctes(
    ["silver_encounter", "silver_condition"],
    """
SELECT CAST(date_trunc('month', e.start_iso_ts) AS DATE) AS month, c.display AS condition_name,
       e.class_code AS encounter_class, COUNT(e.encounter_id) AS encounter_count,
       COUNT(DISTINCT e.pid) AS unique_patients
FROM (SELECT *, replace(patient_ref, 'Patient/', '') AS pid FROM silver_encounter) e
JOIN (SELECT *, replace(patient_ref, 'Patient/', '') AS pid FROM silver_condition) c ON e.pid = c.pid
GROUP BY 1, 2, 3
""",
)

EXPECT_OR_DROP = with_ctes(
    ["silver_claim"],
    """
SELECT 'not_null_patient_id' AS rule, SUM(CASE WHEN patient_id IS NOT NULL THEN 1 ELSE 0 END) AS kept_rows,
       SUM(CASE WHEN patient_id IS NULL THEN 1 ELSE 0 END) AS dropped_rows
FROM silver_claim
""",
)
