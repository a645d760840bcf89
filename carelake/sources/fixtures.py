"""Driver tables -> FHIR-shaped bronze rows.

The driver supplies TPC-H-like tables, not FHIR. This module writes each
resource as one JSON text per row (``raw_json``) with plain column
arithmetic, and injects the data-quality defects of the reference data model
at fixed key residues. Every report then goes *through the JSON*, while the
DuckDB oracle computes the same fields straight from the columns.

Mapping (K is the row key named per resource):

* Organization  supplier; ``org-`` + 6-digit key; one extra row re-exports key 0
  as ``org-900000`` with an upper-case name.
* Practitioner  supplier; NPI has 9 digits when K%23=4; no name when K%29=6.
* Patient       customer; missing birthDate K%20=7; future birthDate K%53=5;
  gender 'M' K%79=3; TEST/ZZTEST name K%131=11; identifier.system null
  K%41=8; a second row ``pat-9``+key with the same MRN when K%20=13.
* Encounter     orders; class from o_orderpriority; start = o_orderdate +
  K%24 h; dangling subject K%97=50; no serviceProvider K%101=30; dangling
  serviceProvider K%149=40; bare subject K%73=44, bare serviceProvider K%113=60;
  end before start K%47=9;
  status 'done' K%59=21; MM/dd/yyyy start K%71=15; no class.system K%67=12;
  line repeated K%31=17.
* Condition     lineitem with its order's customer;
  K = l_partkey; 'UNKNOWN' code without system K%83=7; SNOMED when K%5<2;
  dangling encounter K%139=9; bare subject K%149=21; bare encounter K%151=22.
* Observation   events; K = event_id; negative value K%97=10; no subject K%83=4;
  bare subject K%89=5.
* Procedure     lineitem; K = l_partkey; status 'Done' K%61=5; bare subject
  K%157=23; bare encounter K%163=24.
* Claim         lineitem with its order; K = l_partkey; see ``claim_lines``.

All joins here are equi-joins on the TPC-H keys and run as ordinary shuffles
(or broadcasts when the optimizer's size estimate allows it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.functions import codes
from carelake.sources.bronze import with_bronze_columns
from carelake.sources.tables import Tables

INGEST_BASE = "2026-10-01 00:00:00"
REEXPORT_BASE = "2026-11-01 00:00:00"


def pad(col: Column, width: int = 6) -> Column:
    """Zero-padded decimal text of a non-negative integer, like ``%06d``
    (wider numbers are kept whole, never truncated)."""
    text = col.cast("string")
    return F.when(col < F.lit(10**width), F.lpad(text, width, "0")).otherwise(text)


def iso(ts: Column) -> Column:
    return F.date_format(ts, codes.INSTANT_FORMAT)


def us_text(ts: Column) -> Column:
    return F.date_format(ts, codes.US_DATE_TIME_FORMAT)


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), hours.cast("int"))


def plus_seconds(base: str, seconds: Column) -> Column:
    return (F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast(
        "timestamp"
    )


def pick(index: Column, values: list[str]) -> Column:
    """values[index] as a CASE expression (index is a small non-negative int)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def _lines(df: DataFrame, json_col: Column, resource: str, ingested: Column) -> DataFrame:
    return df.select(
        F.to_json(json_col).alias("raw_json"),
        F.lit(f"{resource}.ndjson").alias("_source_file"),
        ingested.cast("timestamp").alias("_ingested_at"),
    )


def _repeat_when(df: DataFrame, cond: Column) -> DataFrame:
    """Emit a row twice when `cond` holds (single scan, no union)."""
    return df.withColumn("_copy", F.explode(F.when(cond, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop(
        "_copy"
    )


def reference(kind: str, key: Column, bare: Column) -> Column:
    """``Kind/key``, or the key alone where ``bare`` holds."""
    return F.when(bare, key).otherwise(F.concat(F.lit(f"{kind}/"), key))


# --------------------------------------------------------------------- resources
def organization_lines(t: Tables) -> DataFrame:
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("s_suppkey")
    extra = s.where(k == 0).select(
        F.lit(900000).cast("bigint").alias("org_key"), F.upper("s_name").alias("org_name"), "n_name", "s_nationkey",
        F.lit(True).alias("reexport"),
    )
    base = s.select(k.alias("org_key"), F.col("s_name").alias("org_name"), "n_name", "s_nationkey", F.lit(False).alias("reexport"))
    # the re-export keeps the NPI of key 0
    rows = base.unionByName(extra).withColumn("npi_key", F.when(F.col("reexport"), F.lit(0)).otherwise(F.col("org_key")))
    doc = F.struct(
        F.lit("Organization").alias("resourceType"),
        F.concat(F.lit("org-"), pad(F.col("org_key"))).alias("id"),
        F.array(F.struct(F.lit(codes.SYSTEM_NPI).alias("system"), F.concat(F.lit("16"), pad(F.col("npi_key"), 8)).alias("value"))).alias(
            "identifier"
        ),
        F.col("org_name").alias("name"),
        F.lit(True).alias("active"),
        F.array(
            F.struct(
                F.concat(F.lit("City-"), F.col("s_nationkey").cast("string")).alias("city"),
                F.col("n_name").alias("state"),
                F.lit("US").alias("country"),
            )
        ).alias("address"),
        F.array(
            F.struct(
                F.array(
                    F.struct(
                        F.lit(codes.SYSTEM_ORG_TYPE).alias("system"), F.lit("prov").alias("code"),
                        F.lit("Healthcare Provider").alias("display"),
                    )
                ).alias("coding")
            )
        ).alias("type"),
    )
    ingested = F.when(F.col("reexport"), plus_seconds(REEXPORT_BASE, F.lit(0))).otherwise(plus_seconds(INGEST_BASE, F.col("org_key")))
    return _lines(rows, doc, "Organization", ingested)


def practitioner_lines(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    npi = F.concat(F.lit("1"), pad(k, 9))
    doc = F.struct(
        F.lit("Practitioner").alias("resourceType"),
        F.concat(F.lit("pract-"), pad(k)).alias("id"),
        F.array(
            F.struct(
                F.lit(codes.SYSTEM_NPI).alias("system"),
                F.when(k % 23 == 4, F.substring(npi, 1, 9)).otherwise(npi).alias("value"),
            )
        ).alias("identifier"),
        F.when(
            k % 29 == 6, F.lit(None)
        ).otherwise(F.array(F.struct(F.col("s_name").alias("family"), F.array(F.lit("Dr")).alias("given")))).alias("name"),
        F.lit(True).alias("active"),
    )
    return _lines(t.supplier, doc, "Practitioner", plus_seconds(INGEST_BASE, k))


def patient_lines(t: Tables) -> DataFrame:
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    k = F.col("c_custkey")
    test = k % 131 == 11
    birth = (
        F.when(k % 20 == 7, F.lit(None))
        .when(k % 53 == 5, F.date_format(F.date_add(F.lit("2027-01-01").cast("date"), (k % 700).cast("int")), "yyyy-MM-dd"))
        .otherwise(F.date_format(F.date_add(F.lit("1935-01-01").cast("date"), ((k * 37) % 32000).cast("int")), "yyyy-MM-dd"))
    )
    # one row per customer, plus a re-export under a new id when K%20=13
    rows = c.withColumn("copy", F.explode(F.when(k % 20 == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    is_copy = F.col("copy") == 1
    pid = F.when(is_copy, F.concat(F.lit("pat-9"), pad(k))).otherwise(F.concat(F.lit("pat-"), pad(k)))
    doc = F.struct(
        F.lit("Patient").alias("resourceType"),
        pid.alias("id"),
        F.array(
            F.struct(
                F.when(k % 41 == 8, F.lit(None)).otherwise(F.lit(codes.SYSTEM_MRN)).alias("system"),
                F.concat(F.lit("MRN"), (k + 1000000).cast("string")).alias("value"),
            )
        ).alias("identifier"),
        F.array(
            F.struct(
                F.when(test, F.lit("TEST")).otherwise(F.col("c_mktsegment")).alias("family"),
                F.array(F.when(test, F.lit("ZZTEST")).otherwise(F.col("c_name"))).alias("given"),
            )
        ).alias("name"),
        F.when(k % 79 == 3, F.lit("M")).when(k % 2 == 0, F.lit("female")).otherwise(F.lit("male")).alias("gender"),
        birth.alias("birthDate"),
        F.array(
            F.struct(pad((k * 7919) % 99000 + 1000, 5).alias("postalCode"), F.col("n_name").alias("state"))
        ).alias("address"),
        (k % 17 != 0).alias("active"),
    )
    ingested = F.when(is_copy, plus_seconds(REEXPORT_BASE, k)).otherwise(plus_seconds(INGEST_BASE, k))
    return _lines(rows, doc, "Patient", ingested)


def encounter_class_code(priority: Column) -> Column:
    return (
        F.when(priority == "1-URGENT", F.lit("EMER"))
        .when(priority.isin("2-HIGH", "3-MEDIUM"), F.lit("IMP"))
        .otherwise(F.lit("AMB"))
    )


def encounter_lines(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    cust = F.col("o_custkey")
    cls = encounter_class_code(F.col("o_orderpriority"))
    start = plus_hours(F.col("o_orderdate"), k % 24)
    los = F.when(cls == "IMP", 24 + (k * 7) % 216).when(cls == "EMER", 2 + k % 12).otherwise(1 + k % 2)
    end = F.when(k % 47 == 9, plus_hours(start, -(2 + k % 46))).otherwise(plus_hours(start, los))
    subject = (
        F.when(k % 97 == 50, F.concat(F.lit("Patient/pat-8"), pad(cust)))
        .otherwise(reference("Patient", F.concat(F.lit("pat-"), pad(cust)), k % 73 == 44))
    )
    provider = (
        F.when(k % 101 == 30, F.lit(None))
        .when(k % 149 == 40, F.struct(F.lit("Organization/org-999999").alias("reference")))
        .otherwise(F.struct(reference("Organization", F.concat(F.lit("org-"), pad(F.col("site"))), k % 113 == 60).alias("reference")))
    )
    display = pick(F.when(cls == "AMB", 0).when(cls == "EMER", 1).otherwise(2), [d for _, d in codes.ENCOUNTER_CLASSES])
    doc = F.struct(
        F.lit("Encounter").alias("resourceType"),
        F.concat(F.lit("enc-"), k.cast("string")).alias("id"),
        F.when(k % 59 == 21, F.lit("done")).otherwise(F.lit("finished")).alias("status"),
        F.struct(
            F.when(k % 67 == 12, F.lit(None)).otherwise(F.lit(codes.SYSTEM_ACT_CODE)).alias("system"),
            cls.alias("code"),
            F.when(k % 67 == 12, F.lit(None)).otherwise(display).alias("display"),
        ).alias("class"),
        F.struct(subject.alias("reference")).alias("subject"),
        F.array(
            F.struct(F.struct(F.concat(F.lit("Practitioner/pract-"), pad(F.col("site"))).alias("reference")).alias("individual"))
        ).alias("participant"),
        provider.alias("serviceProvider"),
        F.struct(
            F.when(k % 71 == 15, us_text(start)).otherwise(iso(start)).alias("start"),
            iso(end).alias("end"),
        ).alias("period"),
        F.array(
            F.struct(
                F.array(
                    F.struct(F.lit(codes.SYSTEM_ICD10).alias("system"), pick((k % 16).cast("int"), codes.ICD10_CODES).alias("code"))
                ).alias("coding")
            )
        ).alias("reasonCode"),
    )
    # an encounter's facility and practitioner: the smallest supplier of its order's lines
    sites = t.lineitem.groupBy(F.col("l_orderkey").alias("site_order")).agg(F.min("l_suppkey").alias("site"))
    placed = t.orders.join(sites, k == F.col("site_order"), "left").withColumn("site", F.coalesce("site", F.lit(0).cast("long")))
    rows = _repeat_when(placed, k % 31 == 17)
    return _lines(rows, doc, "Encounter", plus_seconds(INGEST_BASE, F.lit(0)))


def _lineitem_with_customer(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "inner")


def condition_code(k: Column) -> tuple[Column, Column, Column]:
    """(system, code, display) of a condition keyed by l_partkey."""
    unknown = k % 83 == 7
    snomed = k % 5 < 2
    sn_idx = ((k / 5).cast("bigint") % 5).cast("int")
    system = F.when(unknown, F.lit(None)).when(snomed, F.lit(codes.SYSTEM_SNOMED)).otherwise(F.lit(codes.SYSTEM_ICD10))
    code = (
        F.when(unknown, F.lit("UNKNOWN"))
        .when(snomed, pick(sn_idx, [c for c, _ in codes.SNOMED_CONDITIONS]))
        .otherwise(pick((k % 16).cast("int"), codes.ICD10_CODES))
    )
    display = F.when(unknown, F.lit(None)).when(snomed, pick(sn_idx, [d for _, d in codes.SNOMED_CONDITIONS]))
    return system, code, display


def condition_lines(t: Tables) -> DataFrame:
    rows = _lineitem_with_customer(t)
    k = F.col("l_partkey")
    system, code, display = condition_code(k)
    doc = F.struct(
        F.lit("Condition").alias("resourceType"),
        F.concat_ws("-", F.lit("cond"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), k.cast("string")).alias(
            "id"
        ),
        F.struct(F.array(F.struct(F.lit("active").alias("code"))).alias("coding")).alias("clinicalStatus"),
        F.struct(F.array(F.struct(system.alias("system"), code.alias("code"), display.alias("display"))).alias("coding")).alias("code"),
        F.struct(reference("Patient", F.concat(F.lit("pat-"), pad(F.col("o_custkey"))), k % 149 == 21).alias("reference")).alias("subject"),
        F.struct(
            F.when(k % 139 == 9, F.concat(F.lit("Encounter/enc-missing-"), F.col("l_orderkey").cast("string")))
            .otherwise(reference("Encounter", F.concat(F.lit("enc-"), F.col("l_orderkey").cast("string")), k % 151 == 22))
            .alias("reference")
        ).alias("encounter"),
        iso(F.col("l_shipdate")).alias("onsetDateTime"),
    )
    return _lines(rows, doc, "Condition", plus_seconds(INGEST_BASE, F.lit(0)))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def observation_lines(t: Tables) -> DataFrame:
    k = F.col("event_id")
    ev_idx = F.lit(len(EVENT_TYPES))
    for i, name in reversed(list(enumerate(EVENT_TYPES))):
        ev_idx = F.when(F.col("event_type") == name, F.lit(i)).otherwise(ev_idx)
    doc = F.struct(
        F.lit("Observation").alias("resourceType"),
        F.concat(F.lit("obs-"), k.cast("string")).alias("id"),
        F.lit("final").alias("status"),
        F.struct(
            F.array(
                F.struct(
                    F.lit(codes.SYSTEM_LOINC).alias("system"),
                    pick(ev_idx, [c for c, _, _ in codes.LOINC_OBSERVATIONS]).alias("code"),
                    pick(ev_idx, [d for _, d, _ in codes.LOINC_OBSERVATIONS]).alias("display"),
                )
            ).alias("coding")
        ).alias("code"),
        F.when(
            k % 83 != 4, F.struct(reference("Patient", F.concat(F.lit("pat-"), pad(F.col("user_id"))), k % 89 == 5).alias("reference"))
        ).alias("subject"),
        iso(F.col("ts")).alias("effectiveDateTime"),
        F.struct(
            F.when(k % 97 == 10, -F.abs(F.col("value"))).otherwise(F.col("value")).alias("value"),
            pick(ev_idx, [u for _, _, u in codes.LOINC_OBSERVATIONS]).alias("unit"),
        ).alias("valueQuantity"),
    )
    return _lines(t.events, doc, "Observation", plus_seconds(INGEST_BASE, F.lit(0)))


def procedure_lines(t: Tables) -> DataFrame:
    rows = _lineitem_with_customer(t)
    k = F.col("l_partkey")
    idx = (k % 5).cast("int")
    doc = F.struct(
        F.lit("Procedure").alias("resourceType"),
        F.concat_ws("-", F.lit("proc"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), k.cast("string")).alias("id"),
        F.when(k % 61 == 5, F.lit("Done")).otherwise(F.lit("completed")).alias("status"),
        F.struct(
            F.array(
                F.struct(
                    F.lit(codes.SYSTEM_CPT).alias("system"),
                    pick(idx, [c for c, _ in codes.CPT_PROCEDURES]).alias("code"),
                    pick(idx, [d for _, d in codes.CPT_PROCEDURES]).alias("display"),
                )
            ).alias("coding")
        ).alias("code"),
        F.struct(reference("Patient", F.concat(F.lit("pat-"), pad(F.col("o_custkey"))), k % 157 == 23).alias("reference")).alias("subject"),
        F.struct(reference("Encounter", F.concat(F.lit("enc-"), F.col("l_orderkey").cast("string")), k % 163 == 24).alias("reference")).alias(
            "encounter"
        ),
        iso(F.col("l_shipdate")).alias("performedDateTime"),
    )
    return _lines(rows, doc, "Procedure", plus_seconds(INGEST_BASE, F.lit(0)))


def claim_status(k: Column, returnflag: Column, linenumber: Column) -> Column:
    return (
        F.when(k % 127 == 5, F.lit(None).cast("string"))
        .when(k % 43 == 0, F.lit("cancelled"))
        .when(k % 47 == 2, F.lit("paid"))
        .when(returnflag == "R", F.when(linenumber % 2 == 0, F.lit("DENIED")).otherwise(F.lit("denied")))
        .when(returnflag == "N", F.lit("rejected"))
        .otherwise(F.lit("active"))
    )


def claim_lines(t: Tables) -> DataFrame:
    """lineitem x orders -> Claim; K = l_partkey.

    status: absent K%127=5, cancelled K%43=0, paid K%47=2, R -> denied ('DENIED' on even line),
    N -> rejected, else active; provider org-999999 when l_suppkey%9=4;
    billable start MM/dd/yyyy when K%71=15, 'not-a-date' when K%89=3; no total
    K%37=1; negative total K%41=2; null currency K%61=3; dangling patient
    K%103=6; dangling encounter K%107=8; no patient K%131=12; no provider
    K%137=13; no encounter link K%109=14; bare patient K%167=25, provider K%173=26,
    encounter K%179=27; billable end before start K%149=17; whole line repeated K%113=9;
    _ingested_at = 2026-10-01 + K seconds.
    """
    rows = _repeat_when(_lineitem_with_customer(t), F.col("l_partkey") % 113 == 9)
    k = F.col("l_partkey")
    okey = F.col("l_orderkey").cast("string")
    ship = F.col("l_shipdate")
    amount = F.when(k % 41 == 2, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    doc = F.struct(
        F.lit("Claim").alias("resourceType"),
        F.concat_ws("-", F.lit("clm"), okey, F.col("l_linenumber").cast("string")).alias("id"),
        claim_status(k, F.col("l_returnflag"), F.col("l_linenumber")).alias("status"),
        F.struct(F.array(F.struct(F.lit("institutional").alias("code"))).alias("coding")).alias("type"),
        F.when(k % 131 != 12, F.struct(
            F.when(k % 103 == 6, F.concat(F.lit("Patient/pat-8"), pad(F.col("o_custkey"))))
            .otherwise(reference("Patient", F.concat(F.lit("pat-"), pad(F.col("o_custkey"))), k % 167 == 25))
            .alias("reference")
        )).alias("patient"),
        F.when(k % 137 != 13, F.struct(
            F.when(F.col("l_suppkey") % 9 == 4, F.lit("Organization/org-999999"))
            .otherwise(reference("Organization", F.concat(F.lit("org-"), pad(F.col("l_suppkey"))), k % 173 == 26))
            .alias("reference")
        )).alias("provider"),
        F.when(k % 109 != 14, F.array(
            F.struct(
                F.array(
                    F.struct(
                        F.when(k % 107 == 8, F.concat(F.lit("Encounter/enc-missing-"), okey))
                        .otherwise(reference("Encounter", F.concat(F.lit("enc-"), okey), k % 179 == 27))
                        .alias("reference")
                    )
                ).alias("encounter")
            )
        )).alias("item"),
        F.struct(
            F.when(k % 89 == 3, F.lit("not-a-date")).when(k % 71 == 15, us_text(ship)).otherwise(iso(ship)).alias("start"),
            iso(plus_hours(ship, F.when(k % 149 == 17, -24).otherwise(24))).alias("end"),
        ).alias("billablePeriod"),
        F.when(k % 37 == 1, F.lit(None))
        .otherwise(F.struct(amount.alias("value"), F.when(k % 61 == 3, F.lit(None)).otherwise(F.lit("USD")).alias("currency")))
        .alias("total"),
    )
    return _lines(rows, doc, "Claim", plus_seconds(INGEST_BASE, k))


BUILDERS = {
    "organization": organization_lines,
    "practitioner": practitioner_lines,
    "patient": patient_lines,
    "encounter": encounter_lines,
    "condition": condition_lines,
    "observation": observation_lines,
    "procedure": procedure_lines,
    "claim": claim_lines,
}


def lines(t: Tables, resource: str) -> DataFrame:
    """The raw lines of a resource with their file and time: what bronze and silver are made from."""
    return BUILDERS[resource](t)


def bronze(t: Tables, resource: str) -> DataFrame:
    return with_bronze_columns(lines(t, resource))


# ---------------------------------------------------------------- manifest
def _entries(df: DataFrame, rtype: str, id_col: Column, rules: list[tuple[Column, str, str]]) -> DataFrame:
    # the defects a row carries; rules it does not meet are nulls, compacted away
    hits = F.array_compact(
        F.array(*[F.when(cond, F.struct(F.lit(kind).alias("k"), F.lit(detail).alias("d"))) for cond, kind, detail in rules])
    )
    return df.select(id_col.alias("resource_id"), F.explode(hits).alias("h")).select(
        F.lit(rtype).alias("resourceType"), "resource_id", F.col("h.k").alias("anomaly_type"), F.col("h.d").alias("detail")
    )


def manifest(t: Tables) -> DataFrame:
    """The injected anomalies of this mapping, one row per (resource, defect):
    the ground truth the data-quality detectors are scored against (Q32)."""
    s, c, o = F.col("s_suppkey"), F.col("c_custkey"), F.col("o_orderkey")
    li = t.lineitem
    k = F.col("l_partkey")
    parts = [
        t.supplier.where(s == 0).select(
            F.lit("Organization").alias("resourceType"), F.lit("org-900000").alias("resource_id"),
            F.lit("duplicate_entity").alias("anomaly_type"), F.lit("re-export of org-000000").alias("detail"),
        ),
        _entries(t.supplier, "Practitioner", F.concat(F.lit("pract-"), pad(s)), [
            (s % 23 == 4, "invalid_npi", "NPI has 9 digits"),
            (s % 29 == 6, "missing_required_field", "name is absent"),
        ]),
        _entries(t.customer, "Patient", F.concat(F.lit("pat-"), pad(c)), [
            (c % 20 == 7, "missing_required_field", "birthDate is absent"),
            ((c % 53 == 5) & (c % 20 != 7), "future_birthdate", "birthDate is in the future"),
            (c % 79 == 3, "invalid_code", "gender outside the value set"),
            (c % 131 == 11, "test_record", "test patient"),
            (c % 41 == 8, "missing_code_system", "identifier.system is null"),
        ]),
        _entries(t.customer.where(c % 20 == 13), "Patient", F.concat(F.lit("pat-9"), pad(c)), [
            (F.lit(True), "duplicate_resource", "same MRN under a new id"),
        ]),
        _entries(t.orders, "Encounter", F.concat(F.lit("enc-"), o.cast("string")), [
            (o % 97 == 50, "dangling_reference", "subject references a missing patient"),
            (o % 101 == 30, "missing_required_field", "serviceProvider is absent"),
            ((o % 149 == 40) & (o % 101 != 30), "dangling_reference", "serviceProvider references a missing organization"),
            ((o % 73 == 44) & (o % 97 != 50), "malformed_reference", "bare subject id"),
            ((o % 113 == 60) & (o % 101 != 30) & (o % 149 != 40), "malformed_reference", "bare serviceProvider id"),
            (o % 47 == 9, "period_end_before_start", "end before start"),
            (o % 59 == 21, "invalid_status_code", "status outside the value set"),
            (o % 71 == 15, "invalid_date_format", "MM/dd/yyyy start"),
            (o % 67 == 12, "missing_code_system", "class.system is absent"),
            (o % 31 == 17, "duplicate_resource", "line repeated"),
        ]),
        _entries(li, "Condition",
                 F.concat_ws("-", F.lit("cond"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), k.cast("string")), [
            (k % 83 == 7, "invalid_code", "UNKNOWN code without system"),
            (k % 139 == 9, "dangling_reference", "encounter references a missing encounter"),
            ((k % 149 == 21) | ((k % 151 == 22) & (k % 139 != 9)), "malformed_reference", "bare subject or encounter id"),
        ]),
        _entries(t.events, "Observation", F.concat(F.lit("obs-"), F.col("event_id").cast("string")), [
            (F.col("event_id") % 97 == 10, "implausible_value", "negative value"),
            (F.col("event_id") % 83 == 4, "missing_required_field", "subject is absent"),
            ((F.col("event_id") % 89 == 5) & (F.col("event_id") % 83 != 4), "malformed_reference", "bare subject id"),
        ]),
        _entries(li, "Procedure",
                 F.concat_ws("-", F.lit("proc"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), k.cast("string")), [
            (k % 61 == 5, "invalid_status_code", "status outside the value set"),
            ((k % 157 == 23) | (k % 163 == 24), "malformed_reference", "bare subject or encounter id"),
        ]),
        _entries(li, "Claim", F.concat_ws("-", F.lit("clm"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), [
            ((k % 103 == 6) & (k % 131 != 12), "dangling_reference", "patient references a missing patient"),
            ((k % 107 == 8) & (k % 109 != 14), "dangling_reference", "item.encounter references a missing encounter"),
            ((k % 41 == 2) & (k % 37 != 1), "implausible_value", "negative total"),
            (k % 37 == 1, "missing_required_field", "total is absent"),
            ((k % 47 == 2) & (k % 43 != 0) & (k % 127 != 5), "invalid_status_code", "status 'paid'"),
            ((k % 61 == 3) & (k % 37 != 1), "missing_code_system", "currency is null"),
            ((k % 167 == 25) & (k % 103 != 6) & (k % 131 != 12), "malformed_reference", "bare patient id"),
            ((k % 173 == 26) & (k % 137 != 13) & (F.col("l_suppkey") % 9 != 4), "malformed_reference", "bare provider id"),
            ((k % 179 == 27) & (k % 107 != 8) & (k % 109 != 14), "malformed_reference", "bare encounter id"),
            ((k % 149 == 17) & (k % 89 != 3), "period_end_before_start", "billable end before start"),
            (k % 113 == 9, "duplicate_resource", "line repeated"),
        ]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
