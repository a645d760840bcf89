"""Validation, profiling, control and §2.14 job queries."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions import codes, fhir
from carelake.operators import cdc, profile, terms, validate
from carelake.operators.keyed_store import KeyedStore, MaterializedView, merge_changes
from carelake.oracle import reports_sql
from carelake.oracle.base import with_ctes
from carelake.plans import claims_by_patient, provider_claims, sql_text
from carelake.plans.model import Model
from carelake.queries.dq_q import DUP_KEYS
from carelake.queries.silver_q import SILVER_COLUMNS, TIMESTAMP_COLUMNS
from carelake.session import checkpoint_dir
from carelake.sources.bronze import RESOURCES
from carelake.streaming import latest
from carelake.streaming.ingest import batch_twin

G3_GRAIN = provider_claims.GRAIN
G3_METRICS = ["claims_count", "amount_billed", "denied_or_rejected_claims_count", "denial_rate"]
PROFILE_TERMS = [r.lower() for r in RESOURCES] + [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    # what the documents do mention
    "license", "rights reserved", "copyright",
]


#: What the provider report reads of a claim. Two reports that are compared read the stored columns.
G3_CLAIM = ("claim_id", "status", "patient_id", "provider_id", "encounter_id", "billable_start", "billable_end", "total_value", "total_currency", "_ingested_at")


def _g3_sources(m: Model) -> dict:
    return m.sources("organization") | {"claim": m.silver("claim", *G3_CLAIM)}


def _g3(m: Model):
    return provider_claims.build(m.spark, _g3_sources(m))["provider_claims_denial_monthly"]


def validate_output(spark, sf_dir):
    """V2-V7: generic output checks over the provider report, one aggregation."""
    return validate.validate_output(_g3(Model(spark, sf_dir)), G3_GRAIN)


def grain_violations(spark, sf_dir):
    """V3: claim ids that the claim table holds more than once."""
    return validate.grain_violations(Model(spark, sf_dir).silver("claim"), ["claim_id"])


def _g3_changed(m: Model):
    # a changed report to reconcile with: paid claims are left out of it
    return provider_claims.spark_sql(m.spark, _g3_sources(m), [*codes.EXCLUDED_CLAIM_STATUSES, "paid"])


def reconcile(spark, sf_dir):
    """The provider report against a changed one: what differs for each metric."""
    m = Model(spark, sf_dir)
    return validate.reconcile(_g3(m), _g3_changed(m), G3_GRAIN, G3_METRICS)


def reconcile_rows(spark, sf_dir):
    """V11's evidence: the keys that differ, with both values."""
    m = Model(spark, sf_dir)
    return validate.reconcile_rows(_g3(m), _g3_changed(m), G3_GRAIN, G3_METRICS)


def expect_quarantine(spark, sf_dir):
    """The claims that an expectation drops, with the rules they fail."""
    rules = {"has_patient": "patient_id IS NOT NULL", "has_status": "status IS NOT NULL", "total_not_negative": "coalesce(total_value, 0) >= 0"}
    _, out = claims_by_patient.expect_or_drop(Model(spark, sf_dir).silver("claim"), rules)
    return out.select("claim_id", F.array_join("_failed_rules", ",").alias("failed_rules"))


def profile_table(spark, sf_dir):
    """Per-column profile of every silver table."""
    m = Model(spark, sf_dir)
    frames = []
    for r, columns in SILVER_COLUMNS.items():
        df = m.silver(r).select(*[fhir.to_ntz(c).alias(c) if c in TIMESTAMP_COLUMNS else F.col(c) for c in columns])
        frames.append(profile.profile_table(df, r))
    return reduce(lambda x, y: x.unionByName(y), frames)


TYPED = ["customer", "events", "lineitem", "orders"]


def profile_typed_dates(spark, sf_dir):
    """P5: date and time columns of the structured tables."""
    tables = Model(spark, sf_dir).tables
    return reduce(lambda x, y: x.unionByName(y), [d for t in TYPED if (d := profile.typed_dates(tables.get(t), t)) is not None])


def profile_text_dates(spark, sf_dir):
    """P5: date-like text columns of the silver tables and of the structured tables."""
    m = Model(spark, sf_dir)
    # each is read once: large resources are parsed while they are read
    frames = {r: m.once(r, *columns) for r, columns in SILVER_COLUMNS.items()} | {t: m.tables.get(t) for t in TYPED}
    return reduce(lambda x, y: x.unionByName(y), [d for t, df in frames.items() if (d := profile.text_dates(df, t)) is not None])


SAMPLED = {"claim": ["claim_id", "status", "patient_id", "encounter_id"], "condition": ["condition_id", "code", "patient_id"], "procedure": ["procedure_id", "code", "patient_id"]}


def profile_samples(spark, sf_dir):
    """Sample rows of silver tables."""
    m = Model(spark, sf_dir)
    return reduce(lambda x, y: x.unionByName(y), [profile.sample_rows(m.silver(r).select(*columns), r, columns) for r, columns in SAMPLED.items()])


def _documents(m: Model):
    return [m.bronze(r.lower()).select("resource_type", "resource_id", "raw_json") for r in RESOURCES]


def profile_dates(spark, sf_dir):
    """Date-like leaves of every resource, over all rows and arrays."""
    return profile.profile_dates(_documents(Model(spark, sf_dir)))


def profile_references(spark, sf_dir):
    """`Prefix/id` references per resource type, path and prefix."""
    return profile.profile_references(_documents(Model(spark, sf_dir)))


def suggest_join_keys(spark, sf_dir):
    """Reference paths -> target resource_id with hit ratios."""
    return profile.suggest_join_keys(_documents(Model(spark, sf_dir)))


def term_mentions(spark, sf_dir):
    """Documents mentioning table names (case-insensitive substring)."""
    docs = Model(spark, sf_dir).tables.documents
    return profile.term_mentions(docs, "doc_id", "text", PROFILE_TERMS)


def term_table_mentions(spark, sf_dir):
    """P8 for a table of terms: documents that hold a long word of the benchmark passages, by one automaton."""
    t = Model(spark, sf_dir).tables
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM_WORD), F.lit(0))).alias("term"))
    return terms.mentions(t.documents, "doc_id", "text", words)


REPORT_TEXT = """
SELECT coalesce(p.state, 'Unknown') AS state, e.class_code, count(DISTINCT c.claim_id) AS claims, count(*) AS visits,
       round(sum(CAST(c.total_value AS DECIMAL(18,2))), 2) AS billed
FROM {src:encounter} e JOIN {src:claim} c ON c.encounter_id = e.encounter_id
LEFT JOIN (SELECT patient_id, max(state) AS state FROM {src:patient} GROUP BY patient_id) p ON p.patient_id = c.patient_id
WHERE lower(c.status) NOT IN ('cancelled', 'draft') GROUP BY ALL"""


#: What the text reads of its sources, each once.
REPORT_COLUMNS = {"encounter": ("encounter_id", "class_code"), "claim": ("claim_id", "encounter_id", "patient_id", "status", "total_value"), "patient": ("patient_id", "state")}


def sql_text_report(spark, sf_dir):
    """A report given as SQL text with ``{src:name}`` sources."""
    read_once = {r: columns for r, columns in REPORT_COLUMNS.items() if r in sql_text.sources_of(REPORT_TEXT)}
    out = sql_text.report(spark, REPORT_TEXT, Model(spark, sf_dir).sources(once=read_once))
    return out.withColumn("billed", F.col("billed").cast("double"))


def profile_outliers(spark, sf_dir):
    """§2.14 data_profiling: quartiles, IQR fences, outliers of claim totals,
    observation values and encounter lengths of stay."""
    m = Model(spark, sf_dir)
    claims = m.silver("claim").select(F.col("total_value"))
    obs = m.silver("observation").select(F.col("value"))
    enc = m.silver("encounter").select(fhir.length_of_stay_days("start_ts", "end_ts").alias("length_of_stay_days"))
    return (
        profile.profile_outliers(claims, "claim", ["total_value"])
        .unionByName(profile.profile_outliers(obs, "observation", ["value"]))
        .unionByName(profile.profile_outliers(enc, "encounter", ["length_of_stay_days"]))
    )


CUTOFF = "2026-10-01 00:15:00"
CUTOFF_LATER = "2026-10-01 00:40:00"


def cdc_apply(spark, sf_dir):
    """§2.14 cdc_pipeline: claims before the cutoff are the snapshot, later
    ones a change feed (cancelled = delete); latest change per claim wins."""
    m = Model(spark, sf_dir)
    c = m.silver("claim").select("claim_id", "status", "total_value", "_ingested_at")
    cut = F.lit(CUTOFF).cast("timestamp")
    snapshot = c.where(F.col("_ingested_at") < cut)
    changes = c.where(F.col("_ingested_at") >= cut).withColumn(
        "_op", F.when(F.lower("status") == "cancelled", F.lit("delete")).otherwise(F.lit("upsert"))
    )
    out = cdc.apply_changes(snapshot, changes, ["claim_id"], "_ingested_at")
    return out.select("claim_id", "status", "total_value", fhir.to_ntz("_ingested_at").alias("_ingested_at"))


def _feed(m: Model):
    c = m.silver("claim", "claim_id", "status", "total_value", "_ingested_at")
    op = F.when((F.col("_ingested_at") >= F.lit(CUTOFF).cast("timestamp")) & (F.lower("status") == "cancelled"), F.lit("delete")).otherwise(F.lit("upsert"))
    return c.withColumn("_op", op)


def cdc_buckets(spark, sf_dir):
    """§2.14 cdc_pipeline on a table in key buckets: the snapshot, then the change feed in two batches by time, each
    rewriting the buckets that it touches."""
    feed = _feed(Model(spark, sf_dir))
    store = KeyedStore.create(spark, f"{checkpoint_dir(spark)}/cdc-{uuid.uuid4().hex}", feed.drop("_op").schema, ["claim_id"])
    at = F.col("_ingested_at")
    cut, later = (F.lit(t).cast("timestamp") for t in (CUTOFF, CUTOFF_LATER))
    for number, part in enumerate((feed.where((at < cut) | at.isNull()), feed.where((at >= cut) & (at < later)), feed.where(at >= later))):
        merge_changes(store, part, "_ingested_at", batch=number)
    return store.read().select("claim_id", "status", "total_value", fhir.to_ntz("_ingested_at").alias("_ingested_at"))


REJECTED = T.StructType([T.StructField("patient_id", T.StringType()), T.StructField("rejected_claim_count", T.LongType()),
                         T.StructField("rejected_amount", T.DecimalType(28, 2)), T.StructField("last_claim_id", T.StringType())])


def rejected_claims_view(spark, sf_dir):
    """S9, materialized view: rejected claims per patient (rows without a patient are dropped by expectation), made
    from the claims before the cutoff and refreshed with two later arrivals."""
    claims = Model(spark, sf_dir).silver("claim").where("status = 'rejected'")
    view = MaterializedView(
        KeyedStore.create(spark, f"{checkpoint_dir(spark)}/view-{uuid.uuid4().hex}", REJECTED, ["patient_id"]),
        {
            "rejected_claim_count": (F.count(F.lit(1)), "sum"),
            "rejected_amount": (F.sum(F.coalesce(F.col("total_value").try_cast("decimal(18,2)"), F.lit(0))), "sum"),
            "last_claim_id": (F.max("claim_id"), "max"),
        },
        F.col("patient_id").isNotNull(),
    )
    at = F.col("_ingested_at")
    cut, later = (F.lit(t).cast("timestamp") for t in (CUTOFF, CUTOFF_LATER))
    for number, part in enumerate((claims.where((at < cut) | at.isNull()), claims.where((at >= cut) & (at < later)), claims.where(at >= later))):
        view.refresh(part, number)
    return view.read().withColumn("rejected_amount", F.col("rejected_amount").cast("double"))


def reconcile_digest(spark, sf_dir):
    """V11 by checksums of key buckets: the findings of reconcile_rows, comparing the unequal buckets only."""
    m = Model(spark, sf_dir)
    return validate.reconcile_by_digest(_g3(m), _g3_changed(m), G3_GRAIN, G3_METRICS)


#: A user without an event for so long is idle; events may be as late as the delay.
IDLE_MS, DELAY_MS = 12 * 3_600_000, 3_600_000


def stream_latest_event(spark, sf_dir):
    """§2.14 streaming_pipeline, run as a stream: the latest event of each user and whether the user is idle. The
    events land in two parts by time; the query is stopped between them and goes on from its checkpoint."""
    m = Model(spark, sf_dir)
    events = m.tables.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = KeyedStore.create(spark, f"{folder}/latest", latest.output_schema(events.schema), ["user_id"])
    first, last = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    half = F.unix_micros("ts") <= F.lit(((first or 0) + (last or 0)) // 2)
    for part in (events.where(half), events.where(~half)):
        part.write.mode("append").parquet(f"{folder}/landing")
        latest.run_latest(spark, f"{folder}/landing", events.schema, "user_id", ["ts", "event_id"], store, f"{folder}/checkpoint", f"{DELAY_MS} milliseconds", IDLE_MS)
    return store.read().select("user_id", fhir.to_ntz("ts").alias("latest_ts"), "event_id", "event_type", "value", "idle")


def schema_evolution(spark, sf_dir):
    """§2.14 schema_evolution: claims before the cutoff as an old export, whole amounts and no currency, with the
    later ones in today's schema."""
    c = Model(spark, sf_dir).silver("claim")
    late = F.col("_ingested_at") >= F.lit(CUTOFF).cast("timestamp")
    old = c.where(~late).select("claim_id", "status", F.col("total_value").cast("int").alias("total_value"))
    return cdc.evolved_union([old, c.where(late).select("claim_id", "status", "total_value", "total_currency")])


def patient_features(spark, sf_dir):
    """§2.14 ml_feature: per-patient counts, class one-hot, recency, billed
    total and its z-score over patients; nulls filled with 0."""
    m = Model(spark, sf_dir)
    enc = m.silver("encounter").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_encounters"),
        F.sum(F.when(F.col("class_code") == "AMB", 1).otherwise(0)).cast("long").alias("n_amb"),
        F.sum(F.when(F.col("class_code") == "EMER", 1).otherwise(0)).cast("long").alias("n_emer"),
        F.sum(F.when(F.col("class_code") == "IMP", 1).otherwise(0)).cast("long").alias("n_imp"),
        F.max("start_ts").alias("last_start"),
    )
    clm = m.silver("claim").groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_claims"),
        F.sum(F.col("total_value").try_cast("decimal(18,2)")).alias("billed"),
    )
    pats = m.silver("patient").select("patient_id").distinct()
    j = pats.join(enc, "patient_id", "left").join(clm, "patient_id", "left")
    feats = j.select(
        "patient_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["n_encounters", "n_amb", "n_emer", "n_imp", "n_claims"]],
        F.datediff(F.lit(codes.AS_OF_DATE).cast("date"), F.to_date("last_start")).alias("recency_days"),
        F.coalesce(F.col("billed"), F.lit(0)).cast("double").alias("total_billed"),
    )
    stats = feats.agg(F.avg("total_billed").alias("mu"), F.stddev_samp("total_billed").alias("sd"))
    # one row of global statistics: a bounded broadcast
    z = feats.join(F.broadcast(stats), how="left").select(
        *feats.columns,
        F.round(F.when(F.col("sd") > 0, (F.col("total_billed") - F.col("mu")) / F.col("sd")).otherwise(F.lit(0.0)), 6).alias(
            "z_total_billed"
        ),
    )
    return z


MIGRATED = ["claim_id", "status", "total_value", "total_currency"]


def migration_check(spark, sf_dir):
    """§2.14 migration: claim fields read by JSON path from bronze (source) vs the migrated table of the latest
    row of each claim (target): count/min/max/sum per column, and whether they agree."""
    m = Model(spark, sf_dir)
    paths = {"claim_id": "$.id", "status": "$.status", "total_value": "$.total.value", "total_currency": "$.total.currency"}
    source = m.bronze("claim").select(*[
        F.get_json_object("raw_json", path).try_cast("double" if c == "total_value" else "string").alias(c) for c, path in paths.items()
    ])
    target = provider_claims.dedup_claims(m.silver("claim")).select(*MIGRATED)
    # both sides' statistics as rows by column, met by column name
    src, dst = (_col_stats(df, name) for df, name in ((source, "src"), (target, "dst")))
    same = [F.col(f"src_{k}").eqNullSafe(F.col(f"dst_{k}")) for k in ("count", "min", "max", "sum")]
    return src.join(dst, "column_name").withColumn("matches", reduce(lambda x, y: x & y, same))


def _col_stats(df, prefix: str):
    stats = []
    for c in MIGRATED:
        total = F.sum(F.col(c).try_cast("decimal(18,2)")).cast("double") if c == "total_value" else F.lit(None).cast("double")
        stats.append(F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias(f"{prefix}_count"), F.min(c).cast("string").alias(f"{prefix}_min"),
            F.max(c).cast("string").alias(f"{prefix}_max"), total.alias(f"{prefix}_sum"),
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def stream_bronze_batch(spark, sf_dir):
    """Batch twin of the streaming ingest: distinct bronze lines per type."""
    m = Model(spark, sf_dir)
    frames = [m.bronze(r.lower()) for r in RESOURCES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return batch_twin(out)


QUERIES = {
    "validate_output": validate_output,
    "grain_violations": grain_violations,
    "reconcile": reconcile,
    "reconcile_rows": reconcile_rows,
    "expect_quarantine": expect_quarantine,
    "profile_typed_dates": profile_typed_dates,
    "profile_table": profile_table,
    "profile_dates": profile_dates,
    "profile_references": profile_references,
    "suggest_join_keys": suggest_join_keys,
    "profile_text_dates": profile_text_dates,
    "profile_samples": profile_samples,
    "term_mentions": term_mentions,
    "term_table_mentions": term_table_mentions,
    "sql_text_report": sql_text_report,
    "profile_outliers": profile_outliers,
    "cdc_apply": cdc_apply,
    "cdc_buckets": cdc_buckets,
    "rejected_claims_view": rejected_claims_view,
    "reconcile_digest": reconcile_digest,
    "stream_latest_event": stream_latest_event,
    "schema_evolution": schema_evolution,
    "patient_features": patient_features,
    "migration_check": migration_check,
    "stream_bronze_batch": stream_bronze_batch,
}

#: Words that are terms: eight ASCII letters and more.
TERM_WORD = "[a-z]{8,}"

# ------------------------------------------------------------------ oracles
_G3_BODY = reports_sql.PROVIDER_CLAIMS.split("\nSELECT c.provider_id", 1)
G3_CTE_SQL = "SELECT c.provider_id" + _G3_BODY[1]
G3_WITH = _G3_BODY[0]  # "WITH ...," prefix incl. silver, claim_dedup, org_dedup


def _with_g3(final: str) -> str:
    return G3_WITH + ",\ng3 AS (" + G3_CTE_SQL + ")\n" + final


_G3_COLS = ["provider_id", "provider_name", "provider_state", "claim_month"] + G3_METRICS
_count_like = ["claims_count", "amount_billed", "denied_or_rejected_claims_count", "denial_rate"]
_CHECK_PARTS = (
    ["SELECT 'not_empty' AS check, CAST(COUNT(*) AS DOUBLE) AS value, COUNT(*) > 0 AS passed FROM g3",
     "SELECT 'grain_not_null', CAST(SUM(CASE WHEN provider_id IS NULL OR provider_name IS NULL OR provider_state IS NULL "
     "OR claim_month IS NULL THEN 1 ELSE 0 END) AS DOUBLE), SUM(CASE WHEN provider_id IS NULL OR provider_name IS NULL "
     "OR provider_state IS NULL OR claim_month IS NULL THEN 1 ELSE 0 END) = 0 FROM g3",
     "SELECT 'duplicate_ratio', ROUND(1.0 - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM g3)) / CAST(COUNT(*) AS DOUBLE), 6), "
     "1.0 - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM g3)) / CAST(COUNT(*) AS DOUBLE) < 0.5 FROM g3"]
    + [f"SELECT 'non_negative:{m}', CAST(SUM(CASE WHEN {m} < 0 THEN 1 ELSE 0 END) AS DOUBLE), "
       f"SUM(CASE WHEN {m} < 0 THEN 1 ELSE 0 END) = 0 FROM g3" for m in _count_like]
    + [f"SELECT 'not_all_null:{c}', CAST(COUNT({c}) AS DOUBLE), COUNT({c}) > 0 FROM g3" for c in _G3_COLS]
)
VALIDATE_SQL = _with_g3(
    "SELECT * FROM checks UNION ALL SELECT 'passed/' || COUNT(*), CAST(SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS DOUBLE), bool_and(passed) FROM checks"
).replace("\nSELECT * FROM checks", ",\nchecks AS (" + "\nUNION ALL\n".join(_CHECK_PARTS) + ")\nSELECT * FROM checks")

GRAIN_SQL = with_ctes(["silver_claim"], "SELECT claim_id, COUNT(*) AS row_count FROM silver_claim GROUP BY 1 HAVING COUNT(*) > 1")

# the changed report: the same SQL without paid claims
_G3_CHANGED = G3_CTE_SQL.replace("'entered-in-error')", "'entered-in-error', 'paid')")
_PAIRED = (
    ",\nchanged AS (" + _G3_CHANGED + "),\npaired AS (SELECT * FROM (SELECT *, 1 AS here FROM g3) a FULL OUTER JOIN (SELECT "
    + ", ".join(f"{c} AS e_{c}" for c in _G3_COLS) + ", 1 AS e_here FROM changed) e ON "
    + " AND ".join(f"a.{c} IS NOT DISTINCT FROM e.e_{c}" for c in G3_GRAIN) + ")\n"
)


def _differs(m: str) -> str:
    return f"here = 1 AND e_here = 1 AND abs(CAST({m} AS DOUBLE) - CAST(e_{m} AS DOUBLE)) > greatest(0.01, abs(CAST(e_{m} AS DOUBLE)) * 1e-6)"


def _paired(final: str) -> str:
    return _with_g3("SELECT 0").removesuffix("\nSELECT 0") + _PAIRED + final


RECONCILE_SQL = _paired("\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, COUNT(CASE WHEN here = 1 AND e_here = 1 THEN 1 END) AS compared, COUNT(CASE WHEN {_differs(m)} THEN 1 END) AS mismatched, "
    "COUNT(CASE WHEN here IS NULL THEN 1 END) AS missing_in_actual, COUNT(CASE WHEN e_here IS NULL THEN 1 END) AS missing_in_expected FROM paired"
    for m in G3_METRICS
))
_KEY_COLS = ", ".join(f"COALESCE({c}, e_{c}) AS {c}" for c in G3_GRAIN)
RECONCILE_ROWS_SQL = _paired("\nUNION ALL\n".join(
    [f"SELECT {_KEY_COLS}, CAST(NULL AS VARCHAR) AS metric, CASE WHEN here IS NULL THEN 'missing_in_actual' ELSE 'missing_in_expected' END AS finding, "
     "CAST(NULL AS DOUBLE) AS actual, CAST(NULL AS DOUBLE) AS expected FROM paired WHERE here IS NULL OR e_here IS NULL"]
    + [f"SELECT {_KEY_COLS}, '{m}', 'differs', CAST({m} AS DOUBLE), CAST(e_{m} AS DOUBLE) FROM paired WHERE {_differs(m)}" for m in G3_METRICS]
))

QUARANTINE_SQL = with_ctes(["silver_claim"], """
SELECT claim_id, concat_ws(',', CASE WHEN patient_id IS NULL THEN 'has_patient' END, CASE WHEN status IS NULL THEN 'has_status' END,
       CASE WHEN total_value < 0 THEN 'total_not_negative' END) AS failed_rules
FROM silver_claim WHERE patient_id IS NULL OR status IS NULL OR total_value < 0""")


def _profile_sql() -> str:
    parts = []
    for r, columns in SILVER_COLUMNS.items():
        for c in columns:
            t = "timestamp_ntz" if c in TIMESTAMP_COLUMNS else "double" if c in ("total_value", "value") else "string"

            def edge(f: str, c=c, t=t) -> str:
                return f"strftime({f}({c}), '%Y-%m-%d %H:%M:%S')" if t == "timestamp_ntz" else f"{f}({c})"

            text, number = t != "double", t == "double"
            parts.append(
                f"SELECT '{r}' AS table_name, '{c}' AS column_name, '{t}' AS data_type, COUNT(*) AS row_count, "
                f"COUNT({c}) AS non_null_count, COUNT(DISTINCT {c}) AS distinct_count, "
                f"{edge('MIN') if text else 'CAST(NULL AS VARCHAR)'} AS min_value, {edge('MAX') if text else 'CAST(NULL AS VARCHAR)'} AS max_value, "
                f"{edge('MIN') if number else 'CAST(NULL AS DOUBLE)'} AS min_numeric, {edge('MAX') if number else 'CAST(NULL AS DOUBLE)'} AS max_numeric "
                f"FROM silver_{r}"
            )
    return with_ctes([f"silver_{r}" for r in SILVER_COLUMNS], "\nUNION ALL\n".join(parts))


TYPED_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT({c}) AS value_count, strftime(MIN({c}), '%Y-%m-%d %H:%M:%S') AS earliest, "
    f"strftime(MAX({c}), '%Y-%m-%d %H:%M:%S') AS latest FROM {t}"
    for t, c in (("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate"))
)


def _outliers_sql() -> str:
    inputs = [
        ("claim", "total_value", "SELECT total_value AS x FROM silver_claim"),
        ("observation", "value", "SELECT value AS x FROM silver_observation"),
        ("encounter", "length_of_stay_days", "SELECT CAST(greatest(datediff('day', start_ts, end_ts), 0) AS DOUBLE) AS x FROM silver_encounter"),
    ]
    parts = []
    for t, c, rows in inputs:
        at = "(SELECT x FROM (SELECT x, ROW_NUMBER() OVER (ORDER BY x) AS rn, COUNT(*) OVER () AS n FROM ({rows}) WHERE x IS NOT NULL) WHERE rn = ceil({p} * n))"
        q1, q2, q3 = (at.format(rows=rows, p=p) for p in (0.25, 0.5, 0.75))
        parts.append(f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, ROUND(1 - COUNT(x) / CAST(COUNT(*) AS DOUBLE), 6) AS null_share,
       COUNT(DISTINCT x) AS distinct_count, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3, any_value(q3 - q1) AS iqr,
       any_value(q1 - 1.5 * (q3 - q1)) AS low_fence, any_value(q3 + 1.5 * (q3 - q1)) AS high_fence,
       COUNT(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers
FROM ({rows}) r, (SELECT {q1} AS q1, {q2} AS q2, {q3} AS q3) q""")
    return with_ctes(["silver_claim", "silver_observation", "silver_encounter"], "\nUNION ALL\n".join(parts))


_TERMS = ", ".join(f"('{t}')" for t in PROFILE_TERMS)
TERM_SQL = f"""
SELECT d.doc_id, t.term FROM documents d, (VALUES {_TERMS}) t(term)
WHERE contains(lower(d.text), t.term)"""

TERM_TABLE_SQL = f"""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TERM_WORD}')) AS term FROM benchmark)
SELECT d.doc_id, t.term FROM documents d, t WHERE contains(lower(d.text), t.term)"""

SQL_TEXT_SQL = with_ctes(["silver_encounter", "silver_claim", "silver_patient"], "SELECT state, class_code, claims, visits, CAST(billed AS DOUBLE) AS billed FROM ("
                         + re.sub(r"\{src:(\w+)\}", r"silver_\1", REPORT_TEXT) + ")")


def _text_dates_sql() -> str:
    tables = {r: (f"silver_{r}", [c for c in columns if c not in TIMESTAMP_COLUMNS and c not in ("total_value", "value")]) for r, columns in SILVER_COLUMNS.items()}
    tables |= {"customer": ("customer", ["c_name", "c_mktsegment"]), "events": ("events", ["event_type", "props"]), "lineitem": ("lineitem", ["l_returnflag", "l_linestatus"]),
               "orders": ("orders", ["o_orderstatus", "o_orderpriority"])}

    def hit(c: str, rx: str) -> str:
        return f"COUNT(CASE WHEN regexp_matches({c}, '{rx}') THEN 1 END)"

    return with_ctes([f"silver_{r}" for r in SILVER_COLUMNS], "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT({c}) AS value_count, {hit(c, profile.ISO_INSTANT)} AS iso_instant, {hit(c, profile.US_DATE)} AS us_date, "
        f"{hit(c, profile.PLAIN_DATE)} AS plain_date FROM {name}" for t, (name, columns) in tables.items() for c in columns
    ))


SAMPLES_SQL = with_ctes([f"silver_{r}" for r in SAMPLED], "\nUNION ALL\n".join(
    f"SELECT '{r}' AS table_name, CAST(k AS INTEGER) AS row_number, '{c}' AS column_name, {c} AS value FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(f'{x} NULLS FIRST' for x in columns)}) AS k FROM silver_{r}) WHERE k <= 5"
    for r, columns in SAMPLED.items() for c in columns
))

CDC_SQL = with_ctes(
    ["silver_claim"],
    f"""
SELECT claim_id, status, total_value, _ingested_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY claim_id ORDER BY _ingested_at DESC NULLS LAST, status DESC NULLS LAST,
         total_value DESC NULLS LAST, _op DESC NULLS LAST) AS rn
  FROM (SELECT claim_id, status, total_value, _ingested_at,
               CASE WHEN _ingested_at < TIMESTAMP '{CUTOFF}' THEN 'upsert'
                    WHEN lower(status) = 'cancelled' THEN 'delete' ELSE 'upsert' END AS _op
        FROM silver_claim))
WHERE rn = 1 AND _op <> 'delete'""",
)

VIEW_SQL = with_ctes(["silver_claim"], """
SELECT patient_id, COUNT(*) AS rejected_claim_count, CAST(SUM(COALESCE(CAST(total_value AS DECIMAL(18,2)), 0)) AS DOUBLE) AS rejected_amount, MAX(claim_id) AS last_claim_id
FROM silver_claim WHERE status = 'rejected' AND patient_id IS NOT NULL GROUP BY 1""")

STREAM_LATEST_SQL = f"""
SELECT user_id, ts AS latest_ts, event_id, event_type, value,
       epoch_ms(ts) + {IDLE_MS} <= (SELECT epoch_ms(MAX(ts)) FROM events) - {DELAY_MS} AS idle
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""

EVOLUTION_SQL = with_ctes(["silver_claim"], f"""
SELECT claim_id, status, CASE WHEN _ingested_at >= TIMESTAMP '{CUTOFF}' THEN total_value ELSE trunc(total_value) END AS total_value,
       CASE WHEN _ingested_at >= TIMESTAMP '{CUTOFF}' THEN total_currency END AS total_currency
FROM silver_claim""")

FEATURES_SQL = with_ctes(
    ["silver_encounter", "silver_claim", "silver_patient"],
    f"""
SELECT f.*, ROUND(CASE WHEN s.sd > 0 THEN (f.total_billed - s.mu) / s.sd ELSE 0.0 END, 6) AS z_total_billed
FROM feats f, (SELECT AVG(total_billed) AS mu, STDDEV_SAMP(total_billed) AS sd FROM feats) s""",
    extra=[("feats", f"""
  SELECT p.patient_id, COALESCE(e.n_encounters, 0) AS n_encounters, COALESCE(e.n_amb, 0) AS n_amb,
         COALESCE(e.n_emer, 0) AS n_emer, COALESCE(e.n_imp, 0) AS n_imp, COALESCE(c.n_claims, 0) AS n_claims,
         datediff('day', CAST(e.last_start AS DATE), DATE '{codes.AS_OF_DATE}') AS recency_days,
         CAST(COALESCE(c.billed, 0) AS DOUBLE) AS total_billed
  FROM (SELECT DISTINCT patient_id FROM silver_patient) p
  LEFT JOIN (SELECT patient_id, COUNT(*) AS n_encounters, SUM(CASE WHEN class_code = 'AMB' THEN 1 ELSE 0 END) AS n_amb,
                    SUM(CASE WHEN class_code = 'EMER' THEN 1 ELSE 0 END) AS n_emer,
                    SUM(CASE WHEN class_code = 'IMP' THEN 1 ELSE 0 END) AS n_imp, MAX(start_ts) AS last_start
             FROM silver_encounter GROUP BY 1) e ON p.patient_id = e.patient_id
  LEFT JOIN (SELECT patient_id, COUNT(*) AS n_claims, SUM(CAST(total_value AS DECIMAL(18,2))) AS billed
             FROM silver_claim GROUP BY 1) c ON p.patient_id = c.patient_id""")],
)


def _migration_sql() -> str:
    def stats(table: str, prefix: str) -> str:
        return "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, COUNT({c}) AS {prefix}_count, CAST(MIN({c}) AS VARCHAR) AS {prefix}_min, CAST(MAX({c}) AS VARCHAR) AS {prefix}_max, "
            + ("CAST(SUM(CAST(total_value AS DECIMAL(18,2))) AS DOUBLE)" if c == "total_value" else "CAST(NULL AS DOUBLE)") + f" AS {prefix}_sum FROM {table}"
            for c in MIGRATED
        )

    same = " AND ".join(f"src_{k} IS NOT DISTINCT FROM dst_{k}" for k in ("count", "min", "max", "sum"))
    return with_ctes(["silver_claim"], f"SELECT *, {same} AS matches FROM src JOIN dst USING (column_name)", extra=[
        ("claim_dedup", reports_sql.CLAIM_DEDUP), ("src", stats("silver_claim", "src")), ("dst", stats("claim_dedup", "dst"))])


_STREAM_TYPES = {
    "organization": "Organization", "practitioner": "Practitioner", "patient": "Patient", "encounter": "Encounter",
    "condition": "Condition", "observation": "Observation", "procedure": "Procedure", "claim": "Claim",
}
STREAM_SQL = with_ctes(
    [f"silver_{r}" for r in _STREAM_TYPES],
    "\nUNION ALL\n".join(
        f"SELECT '{t}' AS resource_type, COUNT(*) AS distinct_lines FROM (SELECT DISTINCT {DUP_KEYS[r]} FROM silver_{r})"
        for r, t in _STREAM_TYPES.items()
    ),
)

ORACLES = {
    "validate_output": VALIDATE_SQL,
    "grain_violations": GRAIN_SQL,
    "reconcile": RECONCILE_SQL,
    "reconcile_rows": RECONCILE_ROWS_SQL,
    "expect_quarantine": QUARANTINE_SQL,
    "profile_typed_dates": TYPED_SQL,
    "profile_outliers": _outliers_sql(),
    "profile_table": _profile_sql(),
    "term_mentions": TERM_SQL,
    "term_table_mentions": TERM_TABLE_SQL,
    "sql_text_report": SQL_TEXT_SQL,
    "profile_text_dates": _text_dates_sql(),
    "profile_samples": SAMPLES_SQL,
    "cdc_apply": CDC_SQL,
    "cdc_buckets": CDC_SQL,
    "rejected_claims_view": VIEW_SQL,
    "reconcile_digest": RECONCILE_ROWS_SQL,
    "stream_latest_event": STREAM_LATEST_SQL,
    "schema_evolution": EVOLUTION_SQL,
    "patient_features": FEATURES_SQL,
    "migration_check": _migration_sql(),
    "stream_bronze_batch": STREAM_SQL,
}

# date-like and reference leaves, enumerated from the silver columns
_DATE_FIELDS = [
    ("Claim", "billablePeriod.start", "silver_claim", "billable_start"),
    ("Claim", "billablePeriod.end", "silver_claim", "billable_end"),
    ("Condition", "onsetDateTime", "silver_condition", "onset"),
    ("Encounter", "period.start", "silver_encounter", "period_start"),
    ("Encounter", "period.end", "silver_encounter", "period_end"),
    ("Observation", "effectiveDateTime", "silver_observation", "effective"),
    ("Patient", "birthDate", "silver_patient", "birth_date"),
    ("Procedure", "performedDateTime", "silver_procedure", "performed"),
]
_REF_FIELDS = [
    ("Claim", "item[].encounter[].reference", "silver_claim", "encounter_ref"),
    ("Claim", "patient.reference", "silver_claim", "patient_ref"),
    ("Claim", "provider.reference", "silver_claim", "provider_ref"),
    ("Condition", "encounter.reference", "silver_condition", "encounter_ref"),
    ("Condition", "subject.reference", "silver_condition", "patient_ref"),
    ("Encounter", "participant[].individual.reference", "silver_encounter", "'Practitioner/' || practitioner_id"),
    ("Encounter", "serviceProvider.reference", "silver_encounter", "organization_ref"),
    ("Encounter", "subject.reference", "silver_encounter", "patient_ref"),
    ("Observation", "subject.reference", "silver_observation", "patient_ref"),
    ("Procedure", "encounter.reference", "silver_procedure", "encounter_ref"),
    ("Procedure", "subject.reference", "silver_procedure", "patient_ref"),
]
_ALL_SILVER = [f"silver_{r}" for r in _STREAM_TYPES]


def _dates_sql() -> str:
    parts = []
    for rtype, path, table, col in _DATE_FIELDS:
        hit = lambda rx: f"CAST(SUM(CASE WHEN regexp_matches({col}, '{rx}') THEN 1 ELSE 0 END) AS BIGINT)"
        parts.append(
            f"SELECT '{rtype}' AS resource_type, '{path}' AS path, COUNT({col}) AS value_count, "
            f"{hit(profile.ISO_INSTANT)} AS iso_instant, {hit(profile.US_DATE)} AS us_date, "
            f"{hit(profile.PLAIN_DATE)} AS plain_date FROM {table}"
        )
    return with_ctes(_ALL_SILVER, "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE iso_instant + us_date + plain_date > 0")


def _refs_rows_sql() -> str:
    rx = profile.REFERENCE
    return "\nUNION ALL\n".join(
        f"SELECT '{rtype}' AS resource_type, '{path}' AS path, regexp_extract({col}, '{rx}', 1) AS prefix, "
        f"regexp_extract({col}, '{rx}', 2) AS ref_id FROM {table} WHERE regexp_matches({col}, '{rx}')"
        for rtype, path, table, col in _REF_FIELDS
    )


_IDS_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS target_type, {t.lower()}_id AS ref_id FROM silver_{r}" for r, t in _STREAM_TYPES.items()
)

ORACLES.update(
    {
        "profile_dates": _dates_sql(),
        "profile_references": with_ctes(
            _ALL_SILVER,
            "SELECT resource_type, path, prefix, COUNT(*) AS references, COUNT(DISTINCT ref_id) AS distinct_ids "
            "FROM refs GROUP BY 1, 2, 3",
            extra=[("refs", _refs_rows_sql())],
        ),
        "suggest_join_keys": with_ctes(
            _ALL_SILVER,
            """SELECT r.resource_type, r.path, r.prefix AS target_type, 'resource_id' AS target_column,
                      COUNT(*) AS references, CAST(SUM(CASE WHEN r.ref_id IN (SELECT ref_id FROM ids i WHERE i.target_type = r.prefix)
                      THEN 1 ELSE 0 END) AS BIGINT) AS hits,
                      ROUND(SUM(CASE WHEN r.ref_id IN (SELECT ref_id FROM ids i WHERE i.target_type = r.prefix) THEN 1 ELSE 0 END)
                            / CAST(COUNT(*) AS DOUBLE), 6) AS hit_ratio
               FROM refs r GROUP BY 1, 2, 3""",
            extra=[("refs", _refs_rows_sql()), ("ids", _IDS_SQL)],
        ),
    }
)
