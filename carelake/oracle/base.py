"""DuckDB twins of the silver tables, computed straight from the driver
columns (no JSON), so each oracle query is an independent formulation of the
same mapping as ``carelake.sources.fixtures`` + ``carelake.plans.silver``.

``with_ctes(["silver_claim"], "SELECT ...")`` prepends the needed CTEs in
dependency order.
"""

from __future__ import annotations

from carelake.functions import codes

ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"
US = "'%m/%d/%Y %H:%M'"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ICD = _list(codes.ICD10_CODES)
SNOMED_CODES = _list([c for c, _ in codes.SNOMED_CONDITIONS])
SNOMED_DISPLAY = _list([d for _, d in codes.SNOMED_CONDITIONS])
LOINC_CODES = _list([c for c, _, _ in codes.LOINC_OBSERVATIONS])
LOINC_DISPLAY = _list([d for _, d, _ in codes.LOINC_OBSERVATIONS])
LOINC_UNIT = _list([u for _, _, u in codes.LOINC_OBSERVATIONS])
CPT_CODES = _list([c for c, _ in codes.CPT_PROCEDURES])
CPT_DISPLAY = _list([d for _, d in codes.CPT_PROCEDURES])

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("claim_rows", [], """
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_shipdate,
         l.l_extendedprice, o.o_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  UNION ALL
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_returnflag, l.l_shipdate,
         l.l_extendedprice, o.o_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey % 113 = 9
""")

cte("silver_claim", ["claim_rows"], f"""
  SELECT 'clm-' || l_orderkey || '-' || l_linenumber AS claim_id,
    CASE WHEN l_partkey % 127 = 5 THEN NULL WHEN l_partkey % 43 = 0 THEN 'cancelled' WHEN l_partkey % 47 = 2 THEN 'paid'
         WHEN l_returnflag = 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'DENIED' ELSE 'denied' END
         WHEN l_returnflag = 'N' THEN 'rejected' ELSE 'active' END AS status,
    'institutional' AS claim_type,
    CASE WHEN l_partkey % 131 = 12 THEN NULL WHEN l_partkey % 103 = 6 THEN 'pat-8' ELSE 'pat-' END || printf('%06d', o_custkey) AS patient_id,
    CASE WHEN l_partkey % 137 = 13 THEN NULL WHEN l_suppkey % 9 = 4 THEN 'org-999999' ELSE 'org-' || printf('%06d', l_suppkey) END AS provider_id,
    CASE WHEN l_partkey % 109 = 14 THEN NULL WHEN l_partkey % 107 = 8 THEN 'enc-missing-' ELSE 'enc-' END || l_orderkey AS encounter_id,
    CASE WHEN l_partkey % 89 = 3 THEN 'not-a-date' WHEN l_partkey % 71 = 15 THEN strftime(l_shipdate, {US})
         ELSE strftime(l_shipdate, {ISO}) END AS billable_start,
    strftime(l_shipdate + to_days(CASE WHEN l_partkey % 149 = 17 THEN -1 ELSE 1 END), {ISO}) AS billable_end,
    CASE WHEN l_partkey % 37 = 1 THEN NULL WHEN l_partkey % 41 = 2 THEN -l_extendedprice
         ELSE l_extendedprice END AS total_value,
    CASE WHEN l_partkey % 37 = 1 OR l_partkey % 61 = 3 THEN NULL ELSE 'USD' END AS total_currency,
    'Claim.ndjson' AS _source_file,
    TIMESTAMP '2026-10-01 00:00:00' + to_seconds(l_partkey) AS _ingested_at,
    CASE WHEN l_partkey % 131 = 12 THEN NULL WHEN l_partkey % 103 = 6 THEN 'Patient/pat-8' WHEN l_partkey % 167 = 25 THEN 'pat-'
         ELSE 'Patient/pat-' END || printf('%06d', o_custkey) AS patient_ref,
    CASE WHEN l_partkey % 137 = 13 THEN NULL WHEN l_suppkey % 9 = 4 THEN 'Organization/org-999999'
         WHEN l_partkey % 173 = 26 THEN 'org-' || printf('%06d', l_suppkey) ELSE 'Organization/org-' || printf('%06d', l_suppkey) END AS provider_ref,
    CASE WHEN l_partkey % 109 = 14 THEN NULL WHEN l_partkey % 107 = 8 THEN 'Encounter/enc-missing-'
         WHEN l_partkey % 179 = 27 THEN 'enc-' ELSE 'Encounter/enc-' END || l_orderkey AS encounter_ref,
    CASE WHEN l_partkey % 89 = 3 THEN NULL ELSE l_shipdate END AS billable_start_ts,
    CASE WHEN l_partkey % 89 = 3 OR l_partkey % 71 = 15 THEN NULL ELSE l_shipdate END AS billable_start_iso_ts,
    l_shipdate + to_days(CASE WHEN l_partkey % 149 = 17 THEN -1 ELSE 1 END) AS billable_end_ts
  FROM claim_rows
""")

cte("patient_rows", [], """
  SELECT c.c_custkey, c.c_name, c.c_mktsegment, n.n_name, 0 AS copy
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL
  SELECT c.c_custkey, c.c_name, c.c_mktsegment, n.n_name, 1 AS copy
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey % 20 = 13
""")

cte("silver_patient", ["patient_rows"], f"""
  SELECT CASE WHEN copy = 1 THEN 'pat-9' ELSE 'pat-' END || printf('%06d', c_custkey) AS patient_id,
    'MRN' || (c_custkey + 1000000) AS mrn,
    CASE WHEN c_custkey % 41 = 8 THEN NULL ELSE '{codes.SYSTEM_MRN}' END AS mrn_system,
    CASE WHEN c_custkey % 131 = 11 THEN 'TEST' ELSE c_mktsegment END AS last_name,
    CASE WHEN c_custkey % 131 = 11 THEN 'ZZTEST' ELSE c_name END AS first_name,
    CASE WHEN c_custkey % 79 = 3 THEN 'M' WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
    CASE WHEN c_custkey % 20 = 7 THEN NULL
         WHEN c_custkey % 53 = 5 THEN strftime(DATE '2027-01-01' + CAST(c_custkey % 700 AS INTEGER), '%Y-%m-%d')
         ELSE strftime(DATE '1935-01-01' + CAST((c_custkey * 37) % 32000 AS INTEGER), '%Y-%m-%d') END AS birth_date,
    printf('%05d', (c_custkey * 7919) % 99000 + 1000) AS postal_code,
    n_name AS state,
    CASE WHEN c_custkey % 17 <> 0 THEN 'true' ELSE 'false' END AS active,
    'Patient.ndjson' AS _source_file,
    CASE WHEN copy = 1 THEN TIMESTAMP '2026-11-01 00:00:00' ELSE TIMESTAMP '2026-10-01 00:00:00' END
      + to_seconds(c_custkey) AS _ingested_at
  FROM patient_rows
""")

cte("org_rows", [], """
  SELECT s.s_suppkey AS org_key, s.s_name AS org_name, n.n_name, s.s_nationkey, false AS reexport,
         s.s_suppkey AS npi_key
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  UNION ALL
  SELECT 900000, upper(s.s_name), n.n_name, s.s_nationkey, true, 0
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey = 0
""")

cte("silver_organization", ["org_rows"], """
  SELECT 'org-' || printf('%06d', org_key) AS organization_id, '16' || printf('%08d', npi_key) AS npi,
    org_name, 'true' AS org_active, 'prov' AS type_code, 'Healthcare Provider' AS type_display,
    'City-' || s_nationkey AS city, n_name AS org_state, 'US' AS country,
    'Organization.ndjson' AS _source_file,
    CASE WHEN reexport THEN TIMESTAMP '2026-11-01 00:00:00'
         ELSE TIMESTAMP '2026-10-01 00:00:00' + to_seconds(org_key) END AS _ingested_at
  FROM org_rows
""")

cte("silver_practitioner", [], """
  SELECT 'pract-' || printf('%06d', s_suppkey) AS practitioner_id,
    CASE WHEN s_suppkey % 23 = 4 THEN substr('1' || printf('%09d', s_suppkey), 1, 9)
         ELSE '1' || printf('%09d', s_suppkey) END AS npi,
    CASE WHEN s_suppkey % 29 = 6 THEN NULL ELSE s_name END AS last_name,
    CASE WHEN s_suppkey % 29 = 6 THEN NULL ELSE 'Dr' END AS first_name,
    'true' AS active, 'Practitioner.ndjson' AS _source_file,
    TIMESTAMP '2026-10-01 00:00:00' + to_seconds(s_suppkey) AS _ingested_at
  FROM supplier
""")

cte("enc_rows", [], """
  SELECT o_orderkey, o_custkey, COALESCE(s.site, 0) AS site,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'EMER' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'IMP'
         ELSE 'AMB' END AS cls,
    o_orderdate + to_hours(o_orderkey % 24) AS start0
  FROM orders LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS site FROM lineitem GROUP BY 1) s ON o_orderkey = s.l_orderkey
""")

cte("enc_rows2", ["enc_rows"], """
  SELECT *, CASE WHEN o_orderkey % 47 = 9 THEN start0 - to_hours(2 + o_orderkey % 46)
                 ELSE start0 + to_hours(CASE cls WHEN 'IMP' THEN 24 + (o_orderkey * 7) % 216
                                                 WHEN 'EMER' THEN 2 + o_orderkey % 12
                                                 ELSE 1 + o_orderkey % 2 END) END AS end0
  FROM enc_rows
  UNION ALL
  SELECT *, CASE WHEN o_orderkey % 47 = 9 THEN start0 - to_hours(2 + o_orderkey % 46)
                 ELSE start0 + to_hours(CASE cls WHEN 'IMP' THEN 24 + (o_orderkey * 7) % 216
                                                 WHEN 'EMER' THEN 2 + o_orderkey % 12
                                                 ELSE 1 + o_orderkey % 2 END) END AS end0
  FROM enc_rows WHERE o_orderkey % 31 = 17
""")

cte("silver_encounter", ["enc_rows2"], f"""
  SELECT 'enc-' || o_orderkey AS encounter_id,
    CASE WHEN o_orderkey % 59 = 21 THEN 'done' ELSE 'finished' END AS status,
    CASE WHEN o_orderkey % 67 = 12 THEN NULL ELSE '{codes.SYSTEM_ACT_CODE}' END AS class_system,
    cls AS class_code,
    CASE WHEN o_orderkey % 97 = 50 THEN 'Patient/pat-8' WHEN o_orderkey % 73 = 44 THEN 'pat-'
         ELSE 'Patient/pat-' END || printf('%06d', o_custkey) AS patient_ref,
    CASE WHEN o_orderkey % 97 = 50 THEN 'pat-8' ELSE 'pat-' END || printf('%06d', o_custkey) AS patient_id,
    'pract-' || printf('%06d', site) AS practitioner_id,
    CASE WHEN o_orderkey % 101 = 30 THEN NULL WHEN o_orderkey % 149 = 40 THEN 'Organization/org-999999'
         WHEN o_orderkey % 113 = 60 THEN 'org-' || printf('%06d', site) ELSE 'Organization/org-' || printf('%06d', site) END AS organization_ref,
    CASE WHEN o_orderkey % 101 = 30 THEN NULL WHEN o_orderkey % 149 = 40 THEN 'org-999999'
         ELSE 'org-' || printf('%06d', site) END AS organization_id,
    CASE WHEN o_orderkey % 71 = 15 THEN strftime(start0, {US}) ELSE strftime(start0, {ISO}) END AS period_start,
    strftime(end0, {ISO}) AS period_end,
    list_extract({ICD}, CAST(o_orderkey % 16 AS INTEGER) + 1) AS reason_code,
    start0 AS start_ts, end0 AS end_ts,
    CASE WHEN o_orderkey % 71 = 15 THEN NULL ELSE start0 END AS start_iso_ts,
    'Encounter.ndjson' AS _source_file, TIMESTAMP '2026-10-01 00:00:00' AS _ingested_at
  FROM enc_rows2
""")

cte("cond_rows", [], """
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_shipdate, o.o_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")

cte("silver_condition", ["cond_rows"], f"""
  SELECT 'cond-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS condition_id,
    'active' AS clinical_status,
    CASE WHEN l_partkey % 83 = 7 THEN NULL WHEN l_partkey % 5 < 2 THEN '{codes.SYSTEM_SNOMED}'
         ELSE '{codes.SYSTEM_ICD10}' END AS code_system,
    CASE WHEN l_partkey % 83 = 7 THEN 'UNKNOWN'
         WHEN l_partkey % 5 < 2 THEN list_extract({SNOMED_CODES}, CAST((l_partkey // 5) % 5 AS INTEGER) + 1)
         ELSE list_extract({ICD}, CAST(l_partkey % 16 AS INTEGER) + 1) END AS code,
    CASE WHEN l_partkey % 83 = 7 THEN NULL
         WHEN l_partkey % 5 < 2 THEN list_extract({SNOMED_DISPLAY}, CAST((l_partkey // 5) % 5 AS INTEGER) + 1)
         END AS display,
    CASE WHEN l_partkey % 149 = 21 THEN '' ELSE 'Patient/' END || 'pat-' || printf('%06d', o_custkey) AS patient_ref,
    'pat-' || printf('%06d', o_custkey) AS patient_id,
    CASE WHEN l_partkey % 139 = 9 THEN 'Encounter/enc-missing-' WHEN l_partkey % 151 = 22 THEN 'enc-' ELSE 'Encounter/enc-' END || l_orderkey AS encounter_ref,
    CASE WHEN l_partkey % 139 = 9 THEN 'enc-missing-' ELSE 'enc-' END || l_orderkey AS encounter_id,
    strftime(l_shipdate, {ISO}) AS onset,
    'Condition.ndjson' AS _source_file, TIMESTAMP '2026-10-01 00:00:00' AS _ingested_at
  FROM cond_rows
""")

cte("silver_observation", [], f"""
  SELECT 'obs-' || event_id AS observation_id, 'final' AS status,
    list_extract({LOINC_CODES}, ev + 1) AS code,
    list_extract({LOINC_DISPLAY}, ev + 1) AS display,
    CASE WHEN event_id % 83 = 4 THEN NULL ELSE CASE WHEN event_id % 89 = 5 THEN 'pat-' ELSE 'Patient/pat-' END || printf('%06d', user_id) END AS patient_ref,
    CASE WHEN event_id % 83 = 4 THEN NULL ELSE 'pat-' || printf('%06d', user_id) END AS patient_id,
    CAST(NULL AS VARCHAR) AS encounter_id,
    strftime(ts, {ISO}) AS effective,
    CASE WHEN event_id % 97 = 10 THEN -abs(value) ELSE value END AS value,
    list_extract({LOINC_UNIT}, ev + 1) AS unit,
    'Observation.ndjson' AS _source_file, TIMESTAMP '2026-10-01 00:00:00' AS _ingested_at
  FROM (SELECT *, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
                                  WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS ev FROM events)
""")

cte("proc_rows", [], """
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_shipdate, o.o_custkey
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")

cte("silver_procedure", ["proc_rows"], f"""
  SELECT 'proc-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS procedure_id,
    CASE WHEN l_partkey % 61 = 5 THEN 'Done' ELSE 'completed' END AS status,
    list_extract({CPT_CODES}, CAST(l_partkey % 5 AS INTEGER) + 1) AS code,
    list_extract({CPT_DISPLAY}, CAST(l_partkey % 5 AS INTEGER) + 1) AS display,
    CASE WHEN l_partkey % 157 = 23 THEN '' ELSE 'Patient/' END || 'pat-' || printf('%06d', o_custkey) AS patient_ref,
    'pat-' || printf('%06d', o_custkey) AS patient_id,
    CASE WHEN l_partkey % 163 = 24 THEN '' ELSE 'Encounter/' END || 'enc-' || l_orderkey AS encounter_ref,
    'enc-' || l_orderkey AS encounter_id,
    strftime(l_shipdate, {ISO}) AS performed,
    'Procedure.ndjson' AS _source_file, TIMESTAMP '2026-10-01 00:00:00' AS _ingested_at
  FROM proc_rows
""")


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in CTES[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(names: list[str], final_sql: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH <needed silver CTEs>, <extra CTEs> <final_sql>."""
    parts = [f"{n} AS ({CTES[n][1]})" for n in _order(names)]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" + final_sql
