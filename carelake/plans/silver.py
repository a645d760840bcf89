"""Bronze -> typed silver tables.

Each resource is parsed with ONE ``from_json`` against a pruned schema (only
the paths the reports and rules read), instead of one ``get_json_object``
per field: one JSON parse per row, and the parser skips unrequested fields.
Leaves are read as text and cast with ``try_cast``, which matches reading the
path as a string and casting it (numbers and booleans keep their JSON text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions import fhir

S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _arr(t: T.DataType) -> T.ArrayType:
    return T.ArrayType(t)


REF = _struct(reference=S)
CODING = _arr(_struct(system=S, code=S, display=S))

PAYLOAD_SCHEMAS: dict[str, T.StructType] = {
    "organization": _struct(
        id=S, name=S, active=S,
        identifier=_arr(_struct(system=S, value=S)),
        address=_arr(_struct(city=S, state=S, country=S)),
        type=_arr(_struct(coding=CODING)),
    ),
    "practitioner": _struct(
        id=S, active=S,
        identifier=_arr(_struct(system=S, value=S)),
        name=_arr(_struct(family=S, given=_arr(S))),
    ),
    "patient": _struct(
        id=S, gender=S, birthDate=S, active=S,
        identifier=_arr(_struct(system=S, value=S)),
        name=_arr(_struct(family=S, given=_arr(S))),
        address=_arr(_struct(postalCode=S, state=S)),
    ),
    "encounter": _struct(
        id=S, status=S,
        **{"class": _struct(system=S, code=S, display=S)},
        subject=REF,
        participant=_arr(_struct(individual=REF)),
        serviceProvider=REF,
        period=_struct(start=S, end=S),
        reasonCode=_arr(_struct(coding=CODING)),
    ),
    "condition": _struct(
        id=S,
        clinicalStatus=_struct(coding=CODING),
        code=_struct(coding=CODING),
        subject=REF, encounter=REF, onsetDateTime=S,
    ),
    "observation": _struct(
        id=S, status=S,
        code=_struct(coding=CODING),
        subject=REF, encounter=REF, effectiveDateTime=S,
        valueQuantity=_struct(value=S, unit=S),
    ),
    "procedure": _struct(
        id=S, status=S,
        code=_struct(coding=CODING),
        subject=REF, encounter=REF, performedDateTime=S,
    ),
    "claim": _struct(
        id=S, status=S,
        type=_struct(coding=CODING),
        patient=REF, provider=REF,
        item=_arr(_struct(encounter=_arr(REF))),
        billablePeriod=_struct(start=S, end=S),
        total=_struct(value=S, currency=S),
    ),
}


#: The payload field that each silver column is read from, for the resources that are parsed by column.
FIELDS: dict[str, dict[str, str]] = {
    "encounter": {
        "encounter_id": "id", "status": "status", "class_system": "class", "class_code": "class", "patient_ref": "subject", "patient_id": "subject",
        "practitioner_id": "participant", "organization_ref": "serviceProvider", "organization_id": "serviceProvider", "period_start": "period",
        "period_end": "period", "reason_code": "reasonCode", "start_ts": "period", "end_ts": "period",
    },
    "condition": {
        "condition_id": "id", "clinical_status": "clinicalStatus", "code_system": "code", "code": "code", "display": "code", "patient_ref": "subject",
        "patient_id": "subject", "encounter_ref": "encounter", "encounter_id": "encounter", "onset": "onsetDateTime",
    },
    "observation": {
        "observation_id": "id", "status": "status", "code": "code", "display": "code", "patient_ref": "subject", "patient_id": "subject",
        "encounter_id": "encounter", "effective": "effectiveDateTime", "value": "valueQuantity", "unit": "valueQuantity",
    },
    "procedure": {
        "procedure_id": "id", "status": "status", "code": "code", "display": "code", "patient_ref": "subject", "patient_id": "subject",
        "encounter_ref": "encounter", "encounter_id": "encounter", "performed": "performedDateTime",
    },
    "claim": {
        "claim_id": "id", "status": "status", "claim_type": "type", "patient_ref": "patient", "patient_id": "patient", "provider_ref": "provider",
        "provider_id": "provider", "encounter_ref": "item", "encounter_id": "item", "billable_start": "billablePeriod",
        "billable_end": "billablePeriod", "total_value": "total", "total_currency": "total",
    },
}


def parse_payload(bronze: DataFrame, resource: str, fields: set[str] | None = None) -> DataFrame:
    """bronze -> (j: parsed struct, _source_file, _ingested_at and what else stands beside the line); only ``fields`` are parsed where they are given, the
    others are null.

    The parse is exploded as an array of one: filters on its fields stay above it, where pushed below they would
    parse each line once more."""
    schema = PAYLOAD_SCHEMAS[resource]
    beside = _beside(bronze)
    wanted = [f for f in schema.fields if fields is None or f.name in fields]
    parsed = bronze.select(F.explode(F.array(F.from_json("raw_json", T.StructType(wanted)))).alias("j"), *beside) if wanted else bronze.select(*beside)
    if len(wanted) == len(schema.fields):
        return parsed
    cells = [(F.col(f"j.`{f.name}`") if f in wanted else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return parsed.select(F.struct(*cells).alias("j"), *beside)


def _j(path: str):
    return F.col(f"j.{path}")


def _head(arr):
    """First array element, null when the array is null or empty (ANSI-safe)."""
    return F.try_element_at(arr, F.lit(1))


META = ["_source_file", "_ingested_at"]


def _beside(rows: DataFrame) -> list[str]:
    """The columns that pass through a parse: what the parse gives and reads is not among them."""
    return [*META, *[c for c in rows.columns if c not in {"j", "raw_json", "resource_id", "resource_type", *META}]]


def organization(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "organization", fields)
    return p.select(
        _j("id").alias("organization_id"),
        _head(_j("identifier"))["value"].alias("npi"),
        _j("name").alias("org_name"),
        _j("active").alias("org_active"),
        _head(_head(_j("type"))["coding"])["code"].alias("type_code"),
        _head(_head(_j("type"))["coding"])["display"].alias("type_display"),
        _head(_j("address"))["city"].alias("city"),
        _head(_j("address"))["state"].alias("org_state"),
        _head(_j("address"))["country"].alias("country"),
        *_beside(p),
    )


def practitioner(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "practitioner", fields)
    return p.select(
        _j("id").alias("practitioner_id"),
        _head(_j("identifier"))["value"].alias("npi"),
        _head(_j("name"))["family"].alias("last_name"),
        _head(_head(_j("name"))["given"]).alias("first_name"),
        _j("active").alias("active"),
        *_beside(p),
    )


def patient(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "patient", fields)
    return p.select(
        _j("id").alias("patient_id"),
        _head(_j("identifier"))["value"].alias("mrn"),
        _head(_j("identifier"))["system"].alias("mrn_system"),
        _head(_j("name"))["family"].alias("last_name"),
        _head(_head(_j("name"))["given"]).alias("first_name"),
        _j("gender").alias("gender"),
        _j("birthDate").alias("birth_date"),
        _head(_j("address"))["postalCode"].alias("postal_code"),
        _head(_j("address"))["state"].alias("state"),
        _j("active").alias("active"),
        *_beside(p),
    )


PATIENT_COLUMNS = [
    "patient_id", "mrn", "last_name", "first_name", "gender", "birth_date", "postal_code", "state", "active",
    "_source_file", "_ingested_at",
]


def encounter(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "encounter", fields)
    return p.select(
        _j("id").alias("encounter_id"),
        _j("status").alias("status"),
        _j("class.system").alias("class_system"),
        _j("class.code").alias("class_code"),
        _j("subject.reference").alias("patient_ref"),
        fhir.ref_id(_j("subject.reference")).alias("patient_id"),
        fhir.ref_id(_head(_j("participant"))["individual"]["reference"]).alias("practitioner_id"),
        _j("serviceProvider.reference").alias("organization_ref"),
        fhir.ref_id(_j("serviceProvider.reference")).alias("organization_id"),
        _j("period.start").alias("period_start"),
        _j("period.end").alias("period_end"),
        _head(_head(_j("reasonCode"))["coding"])["code"].alias("reason_code"),
        fhir.parse_instant(_j("period.start")).alias("start_ts"),
        fhir.parse_instant(_j("period.end")).alias("end_ts"),
        *_beside(p),
    )


def condition(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "condition", fields)
    return p.select(
        _j("id").alias("condition_id"),
        _head(_j("clinicalStatus.coding"))["code"].alias("clinical_status"),
        _head(_j("code.coding"))["system"].alias("code_system"),
        _head(_j("code.coding"))["code"].alias("code"),
        _head(_j("code.coding"))["display"].alias("display"),
        _j("subject.reference").alias("patient_ref"),
        fhir.ref_id(_j("subject.reference")).alias("patient_id"),
        _j("encounter.reference").alias("encounter_ref"),
        fhir.ref_id(_j("encounter.reference")).alias("encounter_id"),
        _j("onsetDateTime").alias("onset"),
        *_beside(p),
    )


def observation(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "observation", fields)
    return p.select(
        _j("id").alias("observation_id"),
        _j("status").alias("status"),
        _head(_j("code.coding"))["code"].alias("code"),
        _head(_j("code.coding"))["display"].alias("display"),
        _j("subject.reference").alias("patient_ref"),
        fhir.ref_id(_j("subject.reference")).alias("patient_id"),
        fhir.ref_id(_j("encounter.reference")).alias("encounter_id"),
        _j("effectiveDateTime").alias("effective"),
        fhir.safe_double(_j("valueQuantity.value")).alias("value"),
        _j("valueQuantity.unit").alias("unit"),
        *_beside(p),
    )


def procedure(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "procedure", fields)
    return p.select(
        _j("id").alias("procedure_id"),
        _j("status").alias("status"),
        _head(_j("code.coding"))["code"].alias("code"),
        _head(_j("code.coding"))["display"].alias("display"),
        _j("subject.reference").alias("patient_ref"),
        fhir.ref_id(_j("subject.reference")).alias("patient_id"),
        _j("encounter.reference").alias("encounter_ref"),
        fhir.ref_id(_j("encounter.reference")).alias("encounter_id"),
        _j("performedDateTime").alias("performed"),
        *_beside(p),
    )


def claim(bronze: DataFrame, fields: set[str] | None = None) -> DataFrame:
    p = parse_payload(bronze, "claim", fields)
    enc_ref = _head(_head(_j("item"))["encounter"])["reference"]
    return p.select(
        _j("id").alias("claim_id"),
        _j("status").alias("status"),
        _head(_j("type.coding"))["code"].alias("claim_type"),
        _j("patient.reference").alias("patient_ref"),
        fhir.ref_id(_j("patient.reference")).alias("patient_id"),
        _j("provider.reference").alias("provider_ref"),
        fhir.ref_id(_j("provider.reference")).alias("provider_id"),
        enc_ref.alias("encounter_ref"),
        fhir.ref_id(enc_ref).alias("encounter_id"),
        _j("billablePeriod.start").alias("billable_start"),
        _j("billablePeriod.end").alias("billable_end"),
        fhir.safe_double(_j("total.value")).alias("total_value"),
        _j("total.currency").alias("total_currency"),
        *_beside(p),
    )


CLAIM_COLUMNS = [
    "claim_id", "status", "claim_type", "patient_id", "provider_id", "encounter_id", "billable_start",
    "billable_end", "total_value", "total_currency", "_source_file", "_ingested_at",
]
ORGANIZATION_COLUMNS = [
    "organization_id", "npi", "org_name", "org_active", "type_code", "type_display", "city", "org_state",
    "country", "_source_file", "_ingested_at",
]

PARSERS = {
    "organization": organization,
    "practitioner": practitioner,
    "patient": patient,
    "encounter": encounter,
    "condition": condition,
    "observation": observation,
    "procedure": procedure,
    "claim": claim,
}


def silver(bronze: DataFrame, resource: str, columns: Sequence[str] = ()) -> DataFrame:
    """The silver rows of a resource, or the given columns of them: other fields of its JSON are passed over.

    Columns of ``bronze`` that are asked for by name pass through, for the resources that are parsed by column."""
    by_field = FIELDS.get(resource)
    beside = [c for c in columns if by_field and c not in by_field and c not in META]
    bronze = bronze.select("raw_json", *META, *beside)
    if not columns:
        return PARSERS[resource](bronze)
    fields = by_field and {by_field[c] for c in columns if c in by_field}
    return PARSERS[resource](bronze, fields).select(*columns)
