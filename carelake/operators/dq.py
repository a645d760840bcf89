"""Data-quality detectors.

Output of every detector: (resource_type, resource_id, anomaly_type, detail).

* Row rules are data (``ROW_RULES``): a rule family, the resource, the
  anomaly type, a fixed detail text and a boolean SQL condition over the
  silver columns. All rules of one resource compile into ONE select
  (an array of the failed rules, exploded), so a table is scanned once no
  matter how many rules it has.
* Dangling references: every reference field of every resource is stacked
  into one (target type, target id) table. References and known ids are
  grouped once, with a side marker, which leaves the missing ids; only the
  references to those are joined back.
* Duplicates are aggregations: identical bronze lines (count per id + text >
  1), same MRN under another id, same facility (NPI + case-folded name)
  under another id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions import codes, fhir
from carelake.plans import silver as silver_mod
from carelake.plans.model import Model
from carelake.plans.silver import FIELDS
from carelake.sources.bronze import append_evolving

RESOURCE_TYPES = {
    "organization": ("Organization", "organization_id"),
    "practitioner": ("Practitioner", "practitioner_id"),
    "patient": ("Patient", "patient_id"),
    "encounter": ("Encounter", "encounter_id"),
    "condition": ("Condition", "condition_id"),
    "observation": ("Observation", "observation_id"),
    "procedure": ("Procedure", "procedure_id"),
    "claim": ("Claim", "claim_id"),
}


def _in(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def _spark_literal(text: str) -> str:
    """The inside of a Spark SQL string literal: backslashes are doubled, quotes escaped."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


@dataclass(frozen=True)
class RowRule:
    family: str
    resource: str
    anomaly_type: str
    detail: str
    spark: str


NAME = "lower(coalesce(trim(concat_ws(' ', first_name, last_name)), ''))"
CONDITION_CODES = codes.ICD10_CODES + [c for c, _ in codes.SNOMED_CONDITIONS]


def _malformed(resource: str, col: str, field: str) -> RowRule:
    return RowRule(
        "malformed_references", resource, "malformed_reference",
        f"{field} reference is missing its 'Type/' prefix",
        f"{col} IS NOT NULL AND NOT {col} RLIKE '{codes.WELL_FORMED_REFERENCE}'",
    )


ROW_RULES: list[RowRule] = [
    # required fields
    RowRule("required_fields", "patient", "missing_required_field", "birthDate is absent", "birth_date IS NULL"),
    RowRule("required_fields", "practitioner", "missing_required_field", "name is absent",
            "last_name IS NULL AND first_name IS NULL"),
    RowRule("required_fields", "encounter", "missing_required_field", "serviceProvider is absent",
            "organization_ref IS NULL"),
    RowRule("required_fields", "observation", "missing_required_field", "subject is absent", "patient_ref IS NULL"),
    RowRule("required_fields", "claim", "missing_required_field", "total is absent", "total_value IS NULL"),
    # value sets (case-sensitive)
    RowRule("value_sets", "patient", "invalid_code", "gender is outside the administrative-gender value set",
            f"gender IS NOT NULL AND gender NOT IN {_in(codes.GENDER_VALUES)}"),
    RowRule("value_sets", "encounter", "invalid_status_code", "status is outside the encounter-status value set",
            f"status IS NOT NULL AND status NOT IN {_in(codes.ENCOUNTER_STATUS_VALUES)}"),
    RowRule("value_sets", "procedure", "invalid_status_code", "status is outside the event-status value set",
            f"status IS NOT NULL AND status NOT IN {_in(codes.EVENT_STATUS_VALUES)}"),
    RowRule("value_sets", "claim", "invalid_status_code", "status is outside the fm-status value set",
            f"status IS NOT NULL AND status NOT IN {_in(codes.FM_STATUS_VALUES)}"),
    RowRule("value_sets", "condition", "invalid_code", "code is not a known ICD-10-CM or SNOMED CT code, or has no system",
            f"code_system IS NULL OR code IS NULL OR code NOT IN {_in(CONDITION_CODES)}"),
    # malformed references
    _malformed("encounter", "patient_ref", "subject"),
    _malformed("encounter", "organization_ref", "serviceProvider"),
    _malformed("condition", "patient_ref", "subject"),
    _malformed("condition", "encounter_ref", "encounter"),
    _malformed("observation", "patient_ref", "subject"),
    _malformed("procedure", "patient_ref", "subject"),
    _malformed("procedure", "encounter_ref", "encounter"),
    _malformed("claim", "patient_ref", "patient"),
    _malformed("claim", "provider_ref", "provider"),
    _malformed("claim", "encounter_ref", "item.encounter"),
    # periods
    RowRule("periods", "encounter", "period_end_before_start", "period.end is earlier than period.start",
            "end_ts < start_ts"),
    RowRule("periods", "claim", "period_end_before_start", "billablePeriod.end is earlier than billablePeriod.start",
            "billable_end_ts < billable_start_ts"),
    # date formats: text present but not an ISO 8601 instant
    RowRule("date_formats", "encounter", "invalid_date_format", "period.start is not a FHIR instant",
            "period_start IS NOT NULL AND try_to_timestamp(period_start) IS NULL"),
    RowRule("date_formats", "claim", "invalid_date_format", "billablePeriod.start is not a FHIR instant",
            "billable_start IS NOT NULL AND try_to_timestamp(billable_start) IS NULL"),
    # future birth dates (as-of date is a parameter; default below)
    RowRule("future_birthdates", "patient", "future_birthdate", "birthDate is in the future",
            f"try_to_date(birth_date) > DATE '{codes.AS_OF_DATE}'"),
    # implausible values
    RowRule("implausible_values", "observation", "implausible_value", "valueQuantity is negative", "value < 0"),
    RowRule("implausible_values", "claim", "implausible_value", "total.value is negative", "total_value < 0"),
    # code systems
    RowRule("code_systems", "patient", "missing_code_system", "identifier.system is null", "mrn_system IS NULL"),
    RowRule("code_systems", "encounter", "missing_code_system", "class.system is absent", "class_system IS NULL"),
    RowRule("code_systems", "claim", "missing_code_system", "total.currency is null",
            "total_currency IS NULL AND total_value IS NOT NULL"),
    # identifiers
    RowRule("identifiers", "practitioner", "invalid_npi", "NPI is not 10 digits",
            f"NOT coalesce(npi RLIKE '{codes.NPI_PATTERN}', false)"),
    # test records
    RowRule("test_records", "patient", "test_record", "test patient that should be excluded",
            f"{NAME} RLIKE '{_spark_literal(codes.TEST_NAME_PATTERN)}'"),
]

ROW_FAMILIES = sorted({r.family for r in ROW_RULES})

# reference fields: resource -> [(field name, reference column, target resource)]
REFERENCES = {
    "encounter": [("subject", "patient_ref", "patient"), ("serviceProvider", "organization_ref", "organization")],
    "condition": [("subject", "patient_ref", "patient"), ("encounter", "encounter_ref", "encounter")],
    "observation": [("subject", "patient_ref", "patient")],
    "procedure": [("subject", "patient_ref", "patient"), ("encounter", "encounter_ref", "encounter")],
    "claim": [
        ("patient", "patient_ref", "patient"),
        ("provider", "provider_ref", "organization"),
        ("item.encounter", "encounter_ref", "encounter"),
    ],
}

OUTPUT = ["resource_type", "resource_id", "anomaly_type", "detail"]


def _read_by(rules: list[RowRule], resource: str) -> list[str]:
    """The silver columns that the rules of a resource read, and its id."""
    texts = " ".join(r.spark for r in rules).replace("billable_start_ts", "billable_start").replace("billable_end_ts", "billable_end")
    return [c for c in FIELDS[resource] if c == RESOURCE_TYPES[resource][1] or re.search(rf"\b{c}\b", texts)]


def _rule_input(m: Model, resource: str, rules: list[RowRule], once: bool) -> DataFrame:
    """Silver columns plus the parsed period columns some rules read."""
    df = m.once(resource, *_read_by(rules, resource)) if once and resource in FIELDS else m.silver(resource)
    if {"billable_start", "billable_end"} <= set(df.columns):
        df = _with_periods(df)
    return df


def _with_periods(df: DataFrame) -> DataFrame:
    return df.withColumn("billable_start_ts", fhir.parse_instant("billable_start")).withColumn("billable_end_ts", fhir.parse_instant("billable_end"))


def _failed(rules: list[RowRule]) -> list[str]:
    return [f"coalesce({r.spark}, false)" for r in rules]


def _line_digest() -> list:
    return [F.xxhash64("raw_json").alias("digest"), F.length("raw_json").alias("n_chars")]


def facts(m: Model, resource: str) -> DataFrame:
    """What the detectors need of a large resource, stored: its lines are made and parsed once for all of them.

    resource_id, failed (the numbers of its rules that a row fails; null for none), the referenced ids by field
    (ref0, ref1, ...), digest and n_chars of the line."""
    def build() -> DataFrame:
        rules = [r for r in ROW_RULES if r.resource == resource]
        id_col = RESOURCE_TYPES[resource][1]
        targets = [col.replace("_ref", "_id") for _, col, _ in REFERENCES[resource]]
        read = _read_by(rules, resource)
        rows = silver_mod.silver(m.lines(resource).select("*", *_line_digest()), resource, list(dict.fromkeys([*read, *targets, "digest", "n_chars"])))
        if "billable_start" in read:
            rows = _with_periods(rows)
        failed = _failed(rules)
        numbers = "array_compact(array(" + ", ".join(f"CASE WHEN {bad} THEN {i} END" for i, bad in enumerate(failed)) + "))"
        return rows.select(
            F.col(id_col).alias("resource_id"), F.expr(f"CASE WHEN {' OR '.join(failed)} THEN {numbers} END").alias("failed"),
            *[F.col(c).alias(f"ref{i}") for i, c in enumerate(targets)], "digest", "n_chars",
        )

    return m.stored_as(f"dq-{resource}", build)


def _rule_findings(m: Model, resource: str) -> DataFrame:
    """The row rules' findings of a large resource, from its facts."""
    rules = [r for r in ROW_RULES if r.resource == resource]
    texts = F.array(*[F.struct(F.lit(r.anomaly_type).alias("a"), F.lit(r.detail).alias("d")) for r in rules])
    hit = facts(m, resource).where(F.col("failed").isNotNull()).select("resource_id", F.explode("failed").alias("rule"))
    return hit.select(F.lit(RESOURCE_TYPES[resource][0]).alias("resource_type"), "resource_id", texts[F.col("rule")]["a"].alias("anomaly_type"), texts[F.col("rule")]["d"].alias("detail"))


def row_rule_detections(m: Model, families=None, by_facts: bool = False) -> DataFrame | None:
    """All row rules of the requested families, one select per resource. Rules of some families read what they need
    of each large table once, all rules read the stored tables, or the facts of the large ones."""
    chosen = [r for r in ROW_RULES if families is None or r.family in families]
    frames = []
    for resource, (rtype, id_col) in RESOURCE_TYPES.items():
        rules = [r for r in chosen if r.resource == resource]
        if not rules:
            continue
        if by_facts and families is None and resource in FIELDS:
            frames.append(_rule_findings(m, resource))
            continue
        # one SQL text for a resource: a call for each part of each rule would take longer than many of the scans
        failed = _failed(rules)
        # rows without a finding leave by one generated filter; the array of failed rules, whose compaction is not
        # generated code, is made for the few others only
        suspect = _rule_input(m, resource, rules, families is not None).where(" OR ".join(failed))
        hits = F.expr("array_compact(array(" + ", ".join(
            f"CASE WHEN {bad} THEN named_struct('a', '{_spark_literal(r.anomaly_type)}', 'd', '{_spark_literal(r.detail)}') END" for bad, r in zip(failed, rules, strict=True)
        ) + "))")
        df = suspect.select(F.col(id_col).alias("resource_id"), F.explode(hits).alias("h"))
        frames.append(
            df.select(F.lit(rtype).alias("resource_type"), "resource_id", F.col("h.a").alias("anomaly_type"), F.col("h.d").alias("detail"))
        )
    return _union(frames)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _linked(m: Model, resource: str) -> DataFrame:
    """The id of a resource and the ids that it references: of a large resource, only these are parsed and stored."""
    return m.silver(resource, RESOURCE_TYPES[resource][1], *[col.replace("_ref", "_id") for _, col, _ in REFERENCES.get(resource, [])])


def dangling_references(m: Model, by_facts: bool = False) -> DataFrame:
    """Reference ids that name no existing resource, from silver or from the facts of the large resources.

    Silver holds the ids with 'Type/' stripped. What is shuffled for a reference is its id, its resource's id and
    the number of its field; the texts of a finding are put in when it is found."""
    targets = sorted({target for fields in REFERENCES.values() for _, _, target in fields})
    links, refs = [], []
    for resource, fields in REFERENCES.items():
        rtype, id_col = RESOURCE_TYPES[resource]
        cells = []
        for i, (field, col, target) in enumerate(fields):
            named = F.col(f"ref{i}" if by_facts else col.replace("_ref", "_id"))
            cells.append(F.struct(F.lit(len(links)).alias("link"), F.lit(targets.index(target)).alias("target"), named.alias("target_id")))
            links.append((rtype, f"{field} references a {target.capitalize()} id that does not exist"))
        rows = facts(m, resource) if by_facts else _linked(m, resource)
        refs.append(rows.select(F.col("resource_id" if by_facts else id_col).alias("resource_id"), F.inline(F.array(*cells))).where(F.col("target_id").isNotNull()))
    stacked = _union(refs)
    known = {t: facts(m, t).select("resource_id") if by_facts and t in FIELDS else _linked(m, t).select(RESOURCE_TYPES[t][1]) for t in targets}
    ids = _union([known[t].toDF("target_id").select(F.lit(i).alias("target"), "target_id") for i, t in enumerate(targets)])
    # which ids are referenced and which exist, in one grouping: a hot id folds where it is read
    named = stacked.select("target", "target_id", F.lit(0).alias("exists")).unionByName(ids.select("target", "target_id", F.lit(1).alias("exists")))
    missing = named.groupBy("target", "target_id").agg(F.max("exists").alias("exists")).where("exists = 0")
    # the references to missing ids: one equi-join, which adaptive execution splits where an id is hot
    found = stacked.join(missing, ["target", "target_id"])
    texts = F.array(*[F.struct(F.lit(rtype).alias("rtype"), F.lit(detail).alias("detail")) for rtype, detail in links])[F.col("link")]
    return found.select(
        texts["rtype"].alias("resource_type"), "resource_id", F.lit("dangling_reference").alias("anomaly_type"), texts["detail"].alias("detail"),
    )


def write_findings(detections: DataFrame, name: str) -> None:
    """The findings as a log table, one batch of rows for each run, with the time they were found."""
    append_evolving(detections.sparkSession, detections.withColumn("_found_at", F.current_timestamp()), name)


def duplicate_lines(m: Model, by_facts: bool = False) -> DataFrame:
    """Identical bronze lines exported more than once (one row per line).

    Lines of all resources are grouped at once, by (resource, id, 64-bit hash of the text, length): the shuffle moves
    numbers in place of the JSON text, and the partial aggregation folds repeated copies of a hot id before the
    exchange. Two texts fall together only if they share the id and the length and their hashes are equal by chance."""
    kinds = [rtype for rtype, _ in RESOURCE_TYPES.values()]
    digests = {r: facts(m, r) if by_facts and r in FIELDS else m.bronze(r).select("resource_id", *_line_digest()) for r in RESOURCE_TYPES}
    lines = _union([digests[r].select(F.lit(i).alias("kind"), "resource_id", "digest", "n_chars") for i, r in enumerate(RESOURCE_TYPES)])
    repeated = lines.groupBy("kind", "resource_id", "digest", "n_chars").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.select(
        F.array(*[F.lit(k) for k in kinds])[F.col("kind")].alias("resource_type"), "resource_id", F.lit("duplicate_resource").alias("anomaly_type"),
        F.lit("identical resource exported more than once").alias("detail"),
    )


def duplicate_mrn(m: Model) -> DataFrame:
    """Patients re-exported under a new id with an MRN already used (Q9)."""
    p = m.silver("patient").select("patient_id", "mrn").where(F.col("mrn").isNotNull())
    first = p.groupBy("mrn").agg(F.min("patient_id").alias("first_id"))
    j = p.join(first, "mrn").where(F.col("patient_id") != F.col("first_id"))
    return j.select(
        F.lit("Patient").alias("resource_type"), F.col("patient_id").alias("resource_id"),
        F.lit("duplicate_resource").alias("anomaly_type"),
        F.concat(F.lit("same identifier.MRN as "), F.col("first_id")).alias("detail"),
    )


def duplicate_entities(m: Model) -> DataFrame:
    """Same facility (NPI + case-folded name) under another id (Q1)."""
    o = m.silver("organization").select("organization_id", "npi", F.lower("org_name").alias("name_key"))
    first = o.groupBy("npi", "name_key").agg(F.min("organization_id").alias("first_id"))
    j = o.join(first, ["npi", "name_key"]).where(F.col("organization_id") != F.col("first_id"))
    return j.select(
        F.lit("Organization").alias("resource_type"), F.col("organization_id").alias("resource_id"),
        F.lit("duplicate_entity").alias("anomaly_type"),
        F.concat(F.lit("same facility as "), F.col("first_id")).alias("detail"),
    )


def all_detections(m: Model) -> DataFrame:
    """Every detector. The rows of the large resources are made and parsed once, into their facts."""
    return _union([row_rule_detections(m, by_facts=True), dangling_references(m, by_facts=True), duplicate_lines(m, by_facts=True), duplicate_mrn(m), duplicate_entities(m)])


def summary(detections: DataFrame) -> DataFrame:
    """Q31: detections per (resource type, anomaly type)."""
    return detections.groupBy("resource_type", "anomaly_type").agg(F.count(F.lit(1)).alias("anomaly_count"))


def score(detections: DataFrame, manifest: DataFrame) -> DataFrame:
    """Q32: detections vs the injected-anomaly manifest, per (resource type,
    anomaly type): found (key in both), missed (manifest only), extra
    (detected only).

    Both sides are unioned with a side marker and grouped once by key: one
    partially aggregated shuffle replaces two distincts and a full outer
    join, and a key repeated many times on one side folds map-side."""
    key = ["resource_type", "resource_id", "anomaly_type"]
    d = detections.select(*key, F.lit(1).alias("_d"), F.lit(None).cast("int").alias("_e"))
    e = manifest.select(
        F.col("resourceType").alias("resource_type"), "resource_id", "anomaly_type",
        F.lit(None).cast("int").alias("_d"), F.lit(1).alias("_e"),
    )
    per_key = d.unionByName(e).groupBy(*key).agg(F.max("_d").alias("_d"), F.max("_e").alias("_e"))
    return per_key.groupBy("resource_type", "anomaly_type").agg(
        F.sum(F.when(F.col("_d").isNotNull() & F.col("_e").isNotNull(), 1).otherwise(0)).cast("long").alias("found"),
        F.sum(F.when(F.col("_d").isNull(), 1).otherwise(0)).cast("long").alias("missed"),
        F.sum(F.when(F.col("_e").isNull(), 1).otherwise(0)).cast("long").alias("extra"),
    )
