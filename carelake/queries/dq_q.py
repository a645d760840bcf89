"""Data-quality detector queries with DuckDB twins."""

from __future__ import annotations

from carelake.operators import dq
from carelake.oracle.base import with_ctes
from carelake.plans.model import Model
from carelake.sources import fixtures

SILVER = [f"silver_{r}" for r in dq.RESOURCE_TYPES]


def _family(*families):
    def run(spark, sf_dir):
        return dq.row_rule_detections(Model(spark, sf_dir), set(families))

    return run


def dq_references(spark, sf_dir):
    return dq.dangling_references(Model(spark, sf_dir))


def dq_duplicates(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dq.duplicate_lines(m).unionByName(dq.duplicate_mrn(m))


def dq_duplicate_entities(spark, sf_dir):
    return dq.duplicate_entities(Model(spark, sf_dir))


def dq_all(spark, sf_dir):
    return dq.all_detections(Model(spark, sf_dir))


def dq_summary(spark, sf_dir):
    return dq.summary(dq.all_detections(Model(spark, sf_dir)))


def dq_score(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dq.score(dq.all_detections(m), fixtures.manifest(m.tables))


QUERIES = {f"dq_{f}": _family(f) for f in dq.ROW_FAMILIES}
QUERIES.update(
    {
        "dq_references": dq_references,
        "dq_duplicates": dq_duplicates,
        "dq_duplicate_entities": dq_duplicate_entities,
        "dq_all": dq_all,
        "dq_summary": dq_summary,
        "dq_score": dq_score,
    }
)


# ------------------------------------------------------------------ oracle
# what each rule must find, from the formula that plants the defect in the driver columns, not from the rule
ROWS = {
    "practitioner": ("supplier", "'pract-' || printf('%06d', s_suppkey)"),
    "patient": ("patient_rows", "CASE WHEN copy = 1 THEN 'pat-9' ELSE 'pat-' END || printf('%06d', c_custkey)"),
    "encounter": ("enc_rows2", "'enc-' || o_orderkey"),
    "condition": ("cond_rows", "'cond-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey"),
    "observation": ("events", "'obs-' || event_id"),
    "procedure": ("proc_rows", "'proc-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey"),
    "claim": ("claim_rows", "'clm-' || l_orderkey || '-' || l_linenumber"),
}
PLANTED = {
    ("required_fields", "patient"): "c_custkey % 20 = 7",
    ("required_fields", "practitioner"): "s_suppkey % 29 = 6",
    ("required_fields", "encounter"): "o_orderkey % 101 = 30",
    ("required_fields", "observation"): "event_id % 83 = 4",
    ("required_fields", "claim"): "l_partkey % 37 = 1",
    ("value_sets", "patient"): "c_custkey % 79 = 3",
    ("value_sets", "encounter"): "o_orderkey % 59 = 21",
    ("value_sets", "procedure"): "l_partkey % 61 = 5",
    ("value_sets", "claim"): "l_partkey % 127 <> 5 AND l_partkey % 43 <> 0 AND (l_partkey % 47 = 2 OR l_returnflag IN ('R', 'N'))",
    ("value_sets", "condition"): "l_partkey % 83 = 7",
    ("malformed_references", "encounter", "subject"): "o_orderkey % 73 = 44 AND o_orderkey % 97 <> 50",
    ("malformed_references", "encounter", "serviceProvider"): "o_orderkey % 113 = 60 AND o_orderkey % 101 <> 30 AND o_orderkey % 149 <> 40",
    ("malformed_references", "condition", "subject"): "l_partkey % 149 = 21",
    ("malformed_references", "condition", "encounter"): "l_partkey % 151 = 22 AND l_partkey % 139 <> 9",
    ("malformed_references", "observation", "subject"): "event_id % 89 = 5 AND event_id % 83 <> 4",
    ("malformed_references", "procedure", "subject"): "l_partkey % 157 = 23",
    ("malformed_references", "procedure", "encounter"): "l_partkey % 163 = 24",
    ("malformed_references", "claim", "patient"): "l_partkey % 167 = 25 AND l_partkey % 103 <> 6 AND l_partkey % 131 <> 12",
    ("malformed_references", "claim", "provider"): "l_partkey % 173 = 26 AND l_partkey % 137 <> 13 AND l_suppkey % 9 <> 4",
    ("malformed_references", "claim", "item.encounter"): "l_partkey % 179 = 27 AND l_partkey % 107 <> 8 AND l_partkey % 109 <> 14",
    ("periods", "encounter"): "o_orderkey % 47 = 9",
    ("periods", "claim"): "l_partkey % 149 = 17 AND l_partkey % 89 <> 3",
    ("date_formats", "encounter"): "o_orderkey % 71 = 15",
    ("date_formats", "claim"): "l_partkey % 89 = 3 OR l_partkey % 71 = 15",
    ("future_birthdates", "patient"): "c_custkey % 53 = 5 AND c_custkey % 20 <> 7",
    ("implausible_values", "observation"): "CASE WHEN event_id % 97 = 10 THEN value <> 0 ELSE value < 0 END",
    ("implausible_values", "claim"): "l_partkey % 41 = 2 AND l_partkey % 37 <> 1",
    ("code_systems", "patient"): "c_custkey % 41 = 8",
    ("code_systems", "encounter"): "o_orderkey % 67 = 12",
    ("code_systems", "claim"): "l_partkey % 61 = 3 AND l_partkey % 37 <> 1",
    ("identifiers", "practitioner"): "s_suppkey % 23 = 4",
    ("test_records", "patient"): "c_custkey % 131 = 11",
}


def _rule_sql(r: dq.RowRule) -> str:
    rtype, _ = dq.RESOURCE_TYPES[r.resource]
    rows, row_id = ROWS[r.resource]
    planted = PLANTED.get((r.family, r.resource, r.detail.split(" ")[0])) or PLANTED[r.family, r.resource]
    detail = r.detail.replace("'", "''")
    return f"SELECT '{rtype}' AS resource_type, {row_id} AS resource_id, '{r.anomaly_type}' AS anomaly_type, '{detail}' AS detail FROM {rows} WHERE {planted}"


def _rules_sql(families) -> str:
    return "\nUNION ALL\n".join(_rule_sql(r) for r in dq.ROW_RULES if r.family in families)


def _refs_sql() -> str:
    parts = []
    for resource, fields in dq.REFERENCES.items():
        rtype, id_col = dq.RESOURCE_TYPES[resource]
        for field, col, target in fields:
            tid = dq.RESOURCE_TYPES[target][1]
            parts.append(
                f"SELECT '{rtype}' AS resource_type, {id_col} AS resource_id, 'dangling_reference' AS anomaly_type, "
                f"'{field} references a {target.capitalize()} id that does not exist' AS detail "
                f"FROM silver_{resource} WHERE {col} IS NOT NULL AND regexp_replace({col}, '^.*?/', '') NOT IN "
                f"(SELECT {tid} FROM silver_{target} WHERE {tid} IS NOT NULL)"
            )
    return "\nUNION ALL\n".join(parts)


DUP_KEYS = {
    "organization": "organization_id, npi, org_name, org_active, type_code, type_display, city, org_state, country",
    "practitioner": "practitioner_id, npi, last_name, first_name, active",
    "patient": "patient_id, mrn, mrn_system, last_name, first_name, gender, birth_date, postal_code, state, active",
    "encounter": "encounter_id, status, class_system, class_code, patient_ref, practitioner_id, organization_ref, "
                 "period_start, period_end, reason_code",
    "condition": "condition_id, clinical_status, code_system, code, display, patient_ref, encounter_ref, onset",
    "observation": "observation_id, status, code, display, patient_ref, effective, value, unit",
    "procedure": "procedure_id, status, code, display, patient_ref, encounter_ref, performed",
    "claim": "claim_id, status, claim_type, patient_ref, provider_ref, encounter_ref, billable_start, billable_end, "
             "total_value, total_currency",
}


def _dup_lines_sql() -> str:
    parts = []
    for resource, keys in DUP_KEYS.items():
        rtype, id_col = dq.RESOURCE_TYPES[resource]
        parts.append(
            f"SELECT '{rtype}' AS resource_type, {id_col} AS resource_id, 'duplicate_resource' AS anomaly_type, "
            f"'identical resource exported more than once' AS detail FROM silver_{resource} "
            f"GROUP BY {keys} HAVING COUNT(*) > 1"
        )
    return "\nUNION ALL\n".join(parts)


DUP_MRN_SQL = """
SELECT 'Patient' AS resource_type, p.patient_id AS resource_id, 'duplicate_resource' AS anomaly_type,
       'same identifier.MRN as ' || f.first_id AS detail
FROM silver_patient p JOIN (SELECT mrn, MIN(patient_id) AS first_id FROM silver_patient WHERE mrn IS NOT NULL GROUP BY mrn) f
  ON p.mrn = f.mrn WHERE p.patient_id <> f.first_id"""

DUP_ENTITY_SQL = """
SELECT 'Organization' AS resource_type, o.organization_id AS resource_id, 'duplicate_entity' AS anomaly_type,
       'same facility as ' || f.first_id AS detail
FROM silver_organization o
JOIN (SELECT npi, lower(org_name) AS name_key, MIN(organization_id) AS first_id FROM silver_organization GROUP BY 1, 2) f
  ON o.npi = f.npi AND lower(o.org_name) = f.name_key WHERE o.organization_id <> f.first_id"""

ALL_SQL = "\nUNION ALL\n".join(
    [_rules_sql(dq.ROW_FAMILIES), _refs_sql(), _dup_lines_sql(), DUP_MRN_SQL, DUP_ENTITY_SQL]
)


def _manifest_sql() -> str:
    def rows(table, rtype, id_expr, rules, where="TRUE"):
        return "\nUNION ALL\n".join(
            f"SELECT '{rtype}' AS resource_type, {id_expr} AS resource_id, '{kind}' AS anomaly_type FROM {table} "
            f"WHERE ({where}) AND ({cond})"
            for cond, kind in rules
        )

    k = "l_partkey"
    return "\nUNION ALL\n".join([
        "SELECT 'Organization' AS resource_type, 'org-900000' AS resource_id, 'duplicate_entity' AS anomaly_type "
        "FROM supplier WHERE s_suppkey = 0",
        rows("supplier", "Practitioner", "'pract-' || printf('%06d', s_suppkey)",
             [("s_suppkey % 23 = 4", "invalid_npi"), ("s_suppkey % 29 = 6", "missing_required_field")]),
        rows("customer", "Patient", "'pat-' || printf('%06d', c_custkey)", [
            ("c_custkey % 20 = 7", "missing_required_field"),
            ("c_custkey % 53 = 5 AND c_custkey % 20 <> 7", "future_birthdate"),
            ("c_custkey % 79 = 3", "invalid_code"), ("c_custkey % 131 = 11", "test_record"),
            ("c_custkey % 41 = 8", "missing_code_system")]),
        rows("customer", "Patient", "'pat-9' || printf('%06d', c_custkey)", [("c_custkey % 20 = 13", "duplicate_resource")]),
        rows("orders", "Encounter", "'enc-' || o_orderkey", [
            ("o_orderkey % 97 = 50", "dangling_reference"), ("o_orderkey % 101 = 30", "missing_required_field"),
            ("o_orderkey % 149 = 40 AND o_orderkey % 101 <> 30", "dangling_reference"),
            ("o_orderkey % 73 = 44 AND o_orderkey % 97 <> 50", "malformed_reference"),
            ("o_orderkey % 113 = 60 AND o_orderkey % 101 <> 30 AND o_orderkey % 149 <> 40", "malformed_reference"),
            ("o_orderkey % 47 = 9", "period_end_before_start"), ("o_orderkey % 59 = 21", "invalid_status_code"),
            ("o_orderkey % 71 = 15", "invalid_date_format"), ("o_orderkey % 67 = 12", "missing_code_system"),
            ("o_orderkey % 31 = 17", "duplicate_resource")]),
        rows("lineitem", "Condition", "'cond-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey",
             [(f"{k} % 83 = 7", "invalid_code"), (f"{k} % 139 = 9", "dangling_reference"),
              (f"{k} % 149 = 21", "malformed_reference"), (f"{k} % 151 = 22 AND {k} % 139 <> 9", "malformed_reference")]),
        rows("events", "Observation", "'obs-' || event_id",
             [("event_id % 97 = 10", "implausible_value"), ("event_id % 83 = 4", "missing_required_field"),
              ("event_id % 89 = 5 AND event_id % 83 <> 4", "malformed_reference")]),
        rows("lineitem", "Procedure", "'proc-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey", [
            (f"{k} % 61 = 5", "invalid_status_code"), (f"{k} % 157 = 23", "malformed_reference"), (f"{k} % 163 = 24", "malformed_reference")]),
        rows("lineitem", "Claim", "'clm-' || l_orderkey || '-' || l_linenumber", [
            (f"{k} % 103 = 6 AND {k} % 131 <> 12", "dangling_reference"), (f"{k} % 107 = 8 AND {k} % 109 <> 14", "dangling_reference"),
            (f"{k} % 41 = 2 AND {k} % 37 <> 1", "implausible_value"), (f"{k} % 37 = 1", "missing_required_field"),
            (f"{k} % 47 = 2 AND {k} % 43 <> 0 AND {k} % 127 <> 5", "invalid_status_code"),
            (f"{k} % 61 = 3 AND {k} % 37 <> 1", "missing_code_system"), (f"{k} % 113 = 9", "duplicate_resource"),
            (f"{k} % 167 = 25 AND {k} % 103 <> 6 AND {k} % 131 <> 12", "malformed_reference"),
            (f"{k} % 173 = 26 AND {k} % 137 <> 13 AND l_suppkey % 9 <> 4", "malformed_reference"),
            (f"{k} % 179 = 27 AND {k} % 107 <> 8 AND {k} % 109 <> 14", "malformed_reference"),
            (f"{k} % 149 = 17 AND {k} % 89 <> 3", "period_end_before_start")]),
    ])


SCORE_SQL = f"""
SELECT COALESCE(d.resource_type, e.resource_type) AS resource_type, COALESCE(d.anomaly_type, e.anomaly_type) AS anomaly_type,
       CAST(SUM(CASE WHEN d.resource_id IS NOT NULL AND e.resource_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS found,
       CAST(SUM(CASE WHEN d.resource_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missed,
       CAST(SUM(CASE WHEN e.resource_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra
FROM (SELECT DISTINCT resource_type, resource_id, anomaly_type FROM all_detections) d
FULL OUTER JOIN (SELECT DISTINCT * FROM manifest) e
  ON d.resource_type = e.resource_type AND d.resource_id = e.resource_id AND d.anomaly_type = e.anomaly_type
GROUP BY 1, 2"""

ORACLES = {f"dq_{f}": with_ctes(SILVER, _rules_sql({f})) for f in dq.ROW_FAMILIES}
ORACLES.update(
    {
        "dq_references": with_ctes(SILVER, _refs_sql()),
        "dq_duplicates": with_ctes(SILVER, _dup_lines_sql() + "\nUNION ALL\n" + DUP_MRN_SQL),
        "dq_duplicate_entities": with_ctes(SILVER, DUP_ENTITY_SQL),
        "dq_all": with_ctes(SILVER, ALL_SQL),
        "dq_summary": with_ctes(
            SILVER, "SELECT resource_type, anomaly_type, COUNT(*) AS anomaly_count FROM all_detections GROUP BY 1, 2",
            extra=[("all_detections", ALL_SQL)],
        ),
        "dq_score": with_ctes(SILVER, SCORE_SQL, extra=[("all_detections", ALL_SQL), ("manifest", _manifest_sql())]),
    }
)
