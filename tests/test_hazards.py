"""Edge cases for the parity hazards of SURVEY §5."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake.functions import fhir
from carelake.plans import claims_by_patient
from tests.helpers import claims, patients


def test_reference_id_strip(spark):
    df = spark.createDataFrame([("Patient/pat-1",), ("pat-2",), (None,), ("a/b/c",)], "r string")
    got = [r[0] for r in df.select(fhir.ref_id("r")).collect()]
    assert got == ["pat-1", "pat-2", None, "b/c"]


def test_two_format_timestamp_and_junk(spark):
    df = spark.createDataFrame([("2025-03-05T14:00:00+00:00",), ("03/18/2025 09:30",), ("not-a-date",)], "s string")
    got = [r[0] for r in df.select(fhir.to_ntz(fhir.parse_instant("s"))).collect()]
    assert str(got[0]) == "2025-03-05 14:00:00" and str(got[1]) == "2025-03-18 09:30:00" and got[2] is None


def test_length_of_stay_never_negative(spark):
    df = spark.createDataFrame([("2025-01-02 00:00:00", "2025-01-01 00:00:00"), ("2025-01-01 00:00:00", None)], "s string, e string")
    df = df.select(F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    assert [r[0] for r in df.select(fhir.length_of_stay_days("s", "e")).collect()] == [0, None]


def test_week_is_monday(spark):
    df = spark.createDataFrame([("2026-09-30 10:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert str(df.select(fhir.week_start("t")).first()[0]) == "2026-09-28"


def test_display_name_cleanup(spark):
    df = spark.createDataFrame([(" Ann ", "  Lee"), ("", "Kim"), (None, None)], "f string, l string")
    assert [r[0] for r in df.select(fhir.display_name("f", "l")).collect()] == ["Ann Lee", "Kim", ""]


def test_active_tristate(spark):
    df = spark.createDataFrame([("TRUE",), ("false",), ("maybe",), (None,)], "a string")
    assert [r[0] for r in df.select(fhir.active_flag("a")).collect()] == [True, False, True, True]


def _claim(cid, status, pid, total, cur="USD", ing="2026-10-01 10:00:00", start="2026-01-05T10:00:00+00:00"):
    return {"claim_id": cid, "status": status, "patient_id": pid, "total_value": total, "total_currency": cur,
            "_ingested_at": ing, "billable_start": start}


def test_g4b_keeps_duplicate_claims_g4c_dedups(spark):
    c = claims(spark, [_claim("c1", "denied", "p1", 10.0), _claim("c1", "Denied", "p1", 10.0, ing="2026-10-01 11:00:00"),
                       _claim("c2", "DENIED", "p1", 5.0, cur="EUR")])
    p = patients(spark, [{"patient_id": "p1", "active": "TRUE", "first_name": "A", "last_name": "B", "gender": "female",
                          "state": "IL", "_ingested_at": "2026-10-01 09:00:00"}])
    b = claims_by_patient.denied_claims_summary(c, p).first()
    assert b.total_denied_claims == 3 and float(b.total_denied_amount) == 25.0 and b.patient_name == "A B"
    u = claims_by_patient.denied_claims_usd(c, p).first()
    # Dedup c1, USD only -> 2 distinct claims, amount 10
    assert u.rejected_claim_count == 2 and float(u.total_rejected_amount) == 10.0


def test_g4c_null_amount_when_no_usd(spark):
    c = claims(spark, [_claim("c1", "denied", "p1", 10.0, cur="EUR")])
    p = patients(spark, [{"patient_id": "p1", "active": "true", "_ingested_at": "2026-10-01 09:00:00"}])
    assert claims_by_patient.denied_claims_usd(c, p).first().total_rejected_amount is None


def test_provider_excluded_status_is_after_dedup(spark):
    from carelake.plans import provider_claims
    from tests.helpers import orgs

    # the latest version is cancelled -> the claim disappears (exclusion after dedup, H6)
    c = claims(spark, [
        {"claim_id": "c1", "status": "paid", "provider_id": "o1", "billable_start": "2026-01-05T10:00:00+00:00",
         "total_value": 5.0, "_ingested_at": "2026-10-01 10:00:00"},
        {"claim_id": "c1", "status": "cancelled", "provider_id": "o1", "billable_start": "2026-01-05T10:00:00+00:00",
         "total_value": 5.0, "_ingested_at": "2026-10-01 11:00:00"}])
    o = orgs(spark, [{"organization_id": "o1", "org_name": "X", "org_state": "IL", "_ingested_at": "2026-10-01 09:00:00"}])
    out = provider_claims.build(spark, {"claim": c, "organization": o})["provider_claims_denial_monthly"]
    assert out.count() == 0
    alt = provider_claims.build(spark, {"claim": c, "organization": o}, excluded_statuses=["canceled"])
    assert alt["provider_claims_denial_monthly"].count() == 1


def test_sql_form_keeps_claims_without_a_status(spark):
    from carelake.plans import provider_claims
    from tests.helpers import orgs

    row = {"provider_id": "o1", "billable_start": "2026-01-05T10:00:00+00:00", "_ingested_at": "2026-10-01 10:00:00"}
    c = claims(spark, [row | {"claim_id": "c1", "status": None, "total_value": 5.0}, row | {"claim_id": "c2", "status": "active", "total_value": 7.0}])
    o = orgs(spark, [{"organization_id": "o1", "org_name": "X", "org_state": "IL", "_ingested_at": "2026-10-01 09:00:00"}])
    sources = {"claim": c, "organization": o}
    for df in (provider_claims.build(spark, sources)["provider_claims_denial_monthly"], provider_claims.spark_sql(spark, sources)):
        assert [(r.claims_count, float(r.amount_billed)) for r in df.collect()] == [(2, 12.0)]
    assert provider_claims.spark_sql(spark, sources, ["active"]).first().claims_count == 1
