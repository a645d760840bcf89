"""The 16 hand-computed acceptance cases of the two report suites,
re-expressed as pytest rows (tolerance max(0.01, 1e-6 |expected|))."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from carelake.operators.validate import acceptance_findings
from carelake.plans import claims_by_patient, provider_claims
from tests.helpers import claims, orgs, patients

MARY = ("org-000001", "St. Mary's Medical Center", "IL")
RIVER = ("org-000002", "Riverside General Hospital", "OH")


def _claim(cid, status, provider, start, total, ingested, currency="USD"):
    return {"claim_id": cid, "status": status, "provider_id": provider, "billable_start": start,
            "total_value": total, "total_currency": currency, "_ingested_at": ingested, "patient_id": "p1"}


def _org(o, ingested):
    return {"organization_id": o[0], "org_name": o[1], "org_state": o[2], "_ingested_at": ingested}


def _row(o, month, n, amount, denied, rate):
    return {"provider_id": o[0], "provider_name": o[1], "provider_state": o[2], "claim_month": month,
            "claims_count": n, "amount_billed": amount, "denied_or_rejected_claims_count": denied, "denial_rate": rate}


PROVIDER_CASES = {
    "basic_aggregation_and_denial_rate_fraction": (
        [_claim("c1", "active", MARY[0], "2026-05-10T08:00:00+00:00", 500.0, "2026-10-01 10:00:00"),
         _claim("c2", "denied", MARY[0], "2026-05-15T10:00:00+00:00", 200.0, "2026-10-01 10:00:01"),
         _claim("c3", "rejected", MARY[0], "2026-05-20T12:00:00+00:00", -50.0, "2026-10-01 10:00:02"),
         _claim("c4", "paid", RIVER[0], "2026-05-05T07:30:00+00:00", 1000.0, "2026-10-01 10:00:03")],
        [_org(MARY, "2026-10-01 09:00:00"), _org(RIVER, "2026-10-01 09:00:01")],
        [_row(MARY, "2026-05-01", 3, 650.0, 2, 0.67), _row(RIVER, "2026-05-01", 1, 1000.0, 0, 0.0)],
    ),
    "deduplicate_by_claim_id_before_aggregation": (
        [_claim("c10", "active", MARY[0], "2026-01-12T09:00:00+00:00", 250.0, "2026-10-02 08:00:00"),
         _claim("c10", "Active", MARY[0], "2026-01-12T09:00:00+00:00", 300.0, "2026-10-02 08:05:00")],
        [_org(MARY, "2026-10-02 07:00:00")],
        [_row(MARY, "2026-01-01", 1, 300.0, 0, 0.0)],
    ),
    "parse_mixed_date_formats_and_exclude_unparsable": (
        [_claim("c20", "paid", RIVER[0], "2025-03-05T14:00:00+00:00", 120.0, "2026-10-03 12:00:00"),
         _claim("c21", "Denied", RIVER[0], "03/18/2025 09:30", 80.0, "2026-10-03 12:00:01"),
         _claim("c22", "active", RIVER[0], "not-a-date", 50.0, "2026-10-03 12:00:02")],
        [_org(RIVER, "2026-10-03 11:00:00")],
        [_row(RIVER, "2025-03-01", 2, 200.0, 1, 0.5)],
    ),
    "exclude_canceled_and_entered_in_error_statuses": (
        [_claim("c30", "denied", MARY[0], "2026-06-02T08:00:00+00:00", 400.0, "2026-10-04 08:00:00"),
         _claim("c31", "PAID", MARY[0], "2026-06-10T08:00:00+00:00", 600.0, "2026-10-04 08:00:01"),
         _claim("c32", "cancelled", MARY[0], "2026-06-12T08:00:00+00:00", 700.0, "2026-10-04 08:00:02"),
         _claim("c33", "entered-in-error", MARY[0], "2026-06-15T08:00:00+00:00", 800.0, "2026-10-04 08:00:03")],
        [_org(MARY, "2026-10-04 07:30:00")],
        [_row(MARY, "2026-06-01", 2, 1000.0, 1, 0.5)],
    ),
    "unmatched_provider_defaults_to_unknown": (
        [_claim("c40", "paid", "org-UNKNOWN", "2026-07-22T10:00:00+00:00", 150.0, "2026-10-05 09:00:00")],
        [_org(("org-000009", "Some Other Org", "TX"), "2026-10-05 08:30:00")],
        [_row(("org-UNKNOWN", "Unknown provider", "Unknown"), "2026-07-01", 1, 150.0, 0, 0.0)],
    ),
    "null_total_value_treated_as_zero_in_amount_billed": (
        [_claim("c50", "paid", RIVER[0], "2026-04-02T08:00:00+00:00", 200.0, "2026-10-06 10:00:00", currency=None),
         _claim("c51", "active", RIVER[0], "2026-04-10T08:00:00+00:00", None, "2026-10-06 10:00:01"),
         _claim("c52", "rejected", RIVER[0], "2026-04-20T08:00:00+00:00", 50.0, "2026-10-06 10:00:02")],
        [_org(RIVER, "2026-10-06 09:00:00")],
        [_row(RIVER, "2026-04-01", 3, 250.0, 1, 0.33)],
    ),
    "case_insensitive_status_mapping_and_non_denied_closed": (
        [_claim("c60", "Active", MARY[0], "2025-11-03T08:00:00+00:00", 100.0, "2026-10-07 07:00:00"),
         _claim("c61", "CLOSED", MARY[0], "2025-11-10T08:00:00+00:00", 200.0, "2026-10-07 07:00:01"),
         _claim("c62", "ReJeCtEd", MARY[0], "2025-11-20T08:00:00+00:00", 300.0, "2026-10-07 07:00:02")],
        [_org(MARY, "2026-10-07 06:30:00")],
        [_row(MARY, "2025-11-01", 3, 600.0, 1, 0.33)],
    ),
    "multiple_providers_multiple_months_grain_integrity": (
        [_claim("c70", "paid", MARY[0], "2026-08-05T08:00:00+00:00", 100.0, "2026-10-08 08:00:00"),
         _claim("c71", "DENIED", RIVER[0], "2026-08-10T08:00:00+00:00", 50.0, "2026-10-08 08:00:01"),
         _claim("c72", "paid", RIVER[0], "2026-08-15T08:00:00+00:00", 25.0, "2026-10-08 08:00:02"),
         _claim("c73", "rejected", RIVER[0], "2026-09-01T08:00:00+00:00", 10.0, "2026-10-08 08:00:03")],
        [_org(MARY, "2026-10-08 07:00:00"), _org(RIVER, "2026-10-08 07:00:01")],
        [_row(MARY, "2026-08-01", 1, 100.0, 0, 0.0), _row(RIVER, "2026-08-01", 2, 75.0, 1, 0.5),
         _row(RIVER, "2026-09-01", 1, 10.0, 1, 1.0)],
    ),
}


@pytest.mark.parametrize("name", list(PROVIDER_CASES))
def test_provider_monthly_acceptance(spark, name):
    c, o, expected = PROVIDER_CASES[name]
    out = provider_claims.build(spark, {"claim": claims(spark, c), "organization": orgs(spark, o)})
    df = out["provider_claims_denial_monthly"]
    kinds = "provider_id string, provider_name string, provider_state string, claim_month string, claims_count long, " \
            "amount_billed double, denied_or_rejected_claims_count long, denial_rate double"
    wanted = spark.createDataFrame(expected, kinds)
    assert acceptance_findings(df, wanted, provider_claims.GRAIN).collect() == []


def test_acceptance_findings_name_what_departs(spark):
    actual = spark.sql("""SELECT * FROM VALUES ('a', DATE '2026-01-01', 1.004D, true, 'x'), ('b', DATE '2026-01-01', 2D, false, 'y'),
                          ('d', DATE '2026-02-01', 3D, true, 'z'), ('d', DATE '2026-02-01', 3D, true, 'z') t(k, day, m, flag, label)""")
    wanted = spark.createDataFrame(
        [("a", "2026-01-01", 1.0, "True", "x", 1), ("b", "2026-01-01", 2.5, "false", None, 1), ("c", "2026-01-01", 0.0, "true", "q", 1), ("d", "2026-02-01", 3.0, "true", "z", 1)],
        "k string, day string, m double, flag string, label string, nope int",
    )
    got = sorted(tuple(r) for r in acceptance_findings(actual, wanted.drop("nope").withColumn("flag", F.lower("flag")), ["k", "day"]).select("k", "column", "finding", "actual", "expected").na.fill("-").collect())
    assert got == [
        ("b", "label", "differs", "y", "-"), ("b", "m", "differs", "2.0", "2.5"), ("c", "-", "missing", "-", "-"), ("d", "-", "key occurs twice", "-", "-"),
    ]
    only = acceptance_findings(actual, wanted.where("k = 'a'").select("k", "day", "nope"), ["k", "day"]).collect()
    assert sorted((r.k, r.finding) for r in only) == [("a", "no such column"), ("b", "not expected"), ("d", "key occurs twice"), ("d", "not expected")]


def _rc(cid, status, patient, start="2026-01-01T10:00:00+00:00"):
    return {"claim_id": cid, "status": status, "patient_id": patient, "billable_start": start, "total_value": 100.0,
            "total_currency": "USD", "_ingested_at": "2026-10-05 10:00:00"}


def _pt(pid, active="true"):
    return {"patient_id": pid, "active": active, "_ingested_at": "2026-10-05 09:00:00"}


REJECTED_CASES = {
    "single_patient_single_rejected_claim_counts_one": (
        [_rc("c1", "rejected", "pat-A"), _rc("c2", "active", "pat-A")], [_pt("pat-A")],
        {"pat-A": 1}, ["pat-B"]),
    "multiple_rejected_and_nonrejected_claims_aggregated_by_patient": (
        [_rc("c10", "rejected", "pat-X"), _rc("c11", "active", "pat-X"), _rc("c12", "rejected", "pat-X"),
         _rc("c20", "rejected", "pat-Y"), _rc("c21", "paid", "pat-Y")], [_pt("pat-X"), _pt("pat-Y")],
        {"pat-X": 2, "pat-Y": 1}, ["pat-Z"]),
    "exclude_claims_without_matching_patient": (
        [_rc("cm1", "rejected", "pat-M"), _rc("cn1", "rejected", "pat-N")], [_pt("pat-M")], {"pat-M": 1}, ["pat-N"]),
    "duplicate_rejected_claim_rows_counted_per_row_not_distinct": (
        [_rc("cd1", "rejected", "pat-D"), _rc("cd1", "rejected", "pat-D", "2026-02-01T08:05:00+00:00"),
         _rc("cd2", "rejected", "pat-D")], [_pt("pat-D")], {"pat-D": 3}, []),
    "null_and_missing_values_do_not_match_or_count": (
        [_rc("cnull1", None, "P1"), _rc("cnull2", "rejected", None), _rc("cmatch", "rejected", "P1")],
        [_pt("P1"), _pt(None, "false")], {"P1": 1}, []),
    "multiple_patient_rows_do_not_double_count": (
        [_rc("cr1", "rejected", "pat-dup"), _rc("cr2", "rejected", "pat-dup")], [_pt("pat-dup"), _pt("pat-dup")],
        {"pat-dup": 2}, []),
    "no_rejected_claims_results_in_empty_output": (
        [_rc("cnr1", "active", "pat-Z1"), _rc("cnr2", "paid", "pat-Z2")], [_pt("pat-Z1"), _pt("pat-Z2")], {},
        ["pat-Z1", "pat-Z2"]),
    "date_formats_covered_no_filtering_by_dates": (
        [_rc("cdt1", "rejected", "pat-DATE", "2026-05-28T19:32:58+00:00"),
         _rc("cdt2", "rejected", "pat-DATE", "2025-01-03T15:46:16+00:00")], [_pt("pat-DATE")], {"pat-DATE": 2}, []),
}


@pytest.mark.parametrize("name", list(REJECTED_CASES))
def test_rejected_claims_acceptance(spark, name):
    c, p, expected, absent = REJECTED_CASES[name]
    df = claims_by_patient.rejected_claim_counts(claims(spark, c), patients(spark, p))
    got = {r["patient_id"]: r["rejected_claim_count"] for r in df.collect()}
    assert got == expected
    for a in absent:
        assert a not in got
