"""Small typed inputs for acceptance-style tests (bounded literal rows)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

CLAIM_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [
        "claim_id", "status", "claim_type", "patient_id", "provider_id", "encounter_id", "billable_start",
        "billable_end", "total_currency", "_source_file"]]
    + [T.StructField("total_value", T.DoubleType()), T.StructField("_ingested_at", T.TimestampType())]
)
PATIENT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [
        "patient_id", "mrn", "last_name", "first_name", "gender", "birth_date", "postal_code", "state", "active",
        "_source_file"]]
    + [T.StructField("_ingested_at", T.TimestampType())]
)
ORG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [
        "organization_id", "npi", "org_name", "org_active", "type_code", "type_display", "city", "org_state",
        "country", "_source_file"]]
    + [T.StructField("_ingested_at", T.TimestampType())]
)


def ts(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def frame(spark, schema, rows: list[dict]):
    data = []
    for r in rows:
        vals = []
        for f in schema.fields:
            v = r.get(f.name)
            if isinstance(f.dataType, T.TimestampType) and isinstance(v, str):
                v = ts(v)
            vals.append(v)
        data.append(tuple(vals))
    return spark.createDataFrame(data, schema)


def claims(spark, rows):
    """rows: (claim_id, status, provider_id or patient_id dict extras...)."""
    return frame(spark, CLAIM_SCHEMA, rows)


def patients(spark, rows):
    return frame(spark, PATIENT_SCHEMA, rows)


def orgs(spark, rows):
    return frame(spark, ORG_SCHEMA, rows)
