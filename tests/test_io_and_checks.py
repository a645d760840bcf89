"""File-level ingest and sinks (S1-S14), streaming ingest, schema checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from carelake.operators import validate
from carelake.plans.model import Model
from carelake.sources import bronze


def _landing(spark, small_dir):
    """Write the fixture bronze lines as NDJSON files (one per resource)."""
    d = tempfile.mkdtemp(prefix="carelake-landing-")
    m = Model(spark, small_dir)
    for r in bronze.RESOURCES:
        lines = [row.raw_json for row in m.bronze(r.lower()).select("raw_json").collect()]
        with open(os.path.join(d, f"{r}.ndjson"), "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return d, m


def test_ndjson_ingest_load_loop_and_catalog(spark, small_dir):
    d, m = _landing(spark, small_dir)
    df = bronze.read_ndjson(spark, os.path.join(d, "Claim.ndjson"))
    assert df.columns == ["raw_json", "resource_id", "resource_type", "_source_file", "_ingested_at"]
    assert df.count() == m.bronze("claim").count()
    assert df.where(F.col("resource_type") != "Claim").count() == 0
    assert df.first()._source_file.endswith("Claim.ndjson")
    spark.sql("CREATE SCHEMA IF NOT EXISTS bronze_t")
    loaded = bronze.load_resources(spark, d, schema="bronze_t")
    assert loaded["bronze_t.claim"] == df.count() and set(loaded) == {f"bronze_t.{r.lower()}" for r in bronze.RESOURCES}
    names = [r.table_name for r in bronze.list_tables(spark, "bronze_t").collect()]
    assert names == sorted(r.lower() for r in bronze.RESOURCES)
    assert bronze.table_exists(spark, "bronze_t.claim") and not bronze.table_exists(spark, "bronze_t.nope")
    counts = {r.resource_type: r.row_count for r in bronze.bronze_counts({"c": spark.table("bronze_t.claim")}).collect()}
    assert counts == {"Claim": df.count()}


def test_blank_lines_are_rows(spark, tmp_path):
    (tmp_path / "Claim.ndjson").write_text('{"id": "c1", "resourceType": "Claim"}\n\n{"id": "c2", "resourceType": "Claim"}\n')
    got = bronze.read_ndjson(spark, str(tmp_path / "Claim.ndjson"))
    assert sorted((r.resource_id or "", r.raw_json == "") for r in got.collect()) == [("", True), ("c1", False), ("c2", False)]


def test_manifest_csv_all_strings(spark, small_dir):
    from carelake.sources import fixtures

    d = tempfile.mkdtemp(prefix="carelake-manifest-")
    path = os.path.join(d, "anomaly_manifest")
    fixtures.manifest(Model(spark, small_dir).tables).coalesce(1).write.option("header", True).csv(path)
    man = bronze.read_manifest(spark, path)
    assert man.columns == bronze.MANIFEST_COLUMNS
    assert all(t == "string" for _, t in man.dtypes) and man.count() > 0


def test_overwrite_and_append_with_schema_evolution(spark):
    a = spark.createDataFrame([("r1", 1)], "request_id string, n int")
    bronze.write_table(a, "ctl_log")
    b = spark.createDataFrame([("r2", 2, "x")], "request_id string, n int, extra string")
    bronze.append_evolving(spark, b, "ctl_log")
    rows = sorted(tuple(r) for r in spark.table("ctl_log").collect())
    assert rows == [("r1", 1, None), ("r2", 2, "x")]


def test_streaming_ingest_matches_batch_twin(spark, small_dir):
    from carelake.streaming.ingest import batch_twin, start_ingest

    d, m = _landing(spark, small_dir)
    out = tempfile.mkdtemp(prefix="carelake-stream-out-")
    ck = tempfile.mkdtemp(prefix="carelake-stream-ck-")
    q = start_ingest(spark, d, out, ck)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    got = {r.resource_type: r.distinct_lines for r in batch_twin(streamed).collect()}
    frames = [m.bronze(r.lower()) for r in bronze.RESOURCES]
    allb = frames[0]
    for f in frames[1:]:
        allb = allb.unionByName(f)
    want = {r.resource_type: r.distinct_lines for r in batch_twin(allb).collect()}
    assert got == want
    # identical lines were dropped within the watermark
    assert streamed.count() == sum(want.values())


def test_contract_and_schema_checks(spark):
    df = spark.createDataFrame([("p", 1, "3")], "provider_id string, claims_count long, amount_billed string")
    c = validate.Contract("t", ["provider_id"], metrics=["claims_count", "amount_billed", "denial_rate"])
    res = {(r.check, r.subject): r.passed for r in validate.check_contract(df, c).collect()}
    assert res == {
        ("column_present", "provider_id"): True, ("column_present", "claims_count"): True, ("column_present", "amount_billed"): True,
        ("column_present", "denial_rate"): False, ("metric_is_number", "claims_count"): True, ("metric_is_number", "amount_billed"): False,
        ("metric_is_number", "denial_rate"): False,
    }
    assert validate.string_typed_metrics(df) == ["amount_billed"]
    assert abs(validate.metric_coverage(df, ["claims_count", "denial_rate"]) - 0.5) < 1e-9
    assert validate.covers_metrics(df, ["claims_count", "denial_rate"]) and not validate.covers_metrics(df, ["a_rate", "b_rate", "claims_count"])
    new = spark.createDataFrame([("p", 1.0)], "provider_id string, claims_count double").schema
    diff = {d["column"]: d["change"] for d in validate.schema_diff(df.schema, new)}
    assert diff == {"claims_count": "retyped", "amount_billed": "dropped"}


def test_validate_output_flags(spark):
    df = spark.createDataFrame([("a", -1), ("a", -1), (None, 2)], "k string, row_count long")
    got = {r.check: r.passed for r in validate.validate_output(df, ["k"]).collect()}
    assert got["not_empty"] and not got["grain_not_null"] and not got["non_negative:row_count"]
    assert got["duplicate_ratio"] and not got["passed/6"]
    ok = {r.check: (r.value, r.passed) for r in validate.validate_output(df.where("row_count = 2 and k is null"), ["row_count"]).collect()}
    assert ok["passed/6"] == (5.0, False) and ok["duplicate_ratio"] == (0.0, True)
    none = {r.check: r.passed for r in validate.validate_output(df.limit(0), ["k"]).collect()}
    assert not none["not_empty"] and none["not_all_null:k"]
    assert [tuple(r) for r in validate.grain_violations(df, ["k"]).collect()] == [("a", 2)]


def test_reconcile_counts_mismatches(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, m double")
    e = spark.createDataFrame([("x", 1.005), ("z", 3.0)], "k string, m double")
    r = validate.reconcile(a, e, ["k"], ["m"]).first()
    assert (r.compared, r.mismatched, r.missing_in_actual, r.missing_in_expected) == (1, 0, 1, 1)
    a = spark.createDataFrame([("x", 1.0), (None, 2.0), ("n", None), ("y", 5.0)], "k string, m double")
    e = spark.createDataFrame([("x", 1.5), (None, 2.0), ("n", 0.0), ("z", 3.0)], "k string, m double")
    got = sorted(map(tuple, validate.reconcile_rows(a, e, ["k"], ["m"]).collect()))
    assert got == [("n", "m", "differs", None, 0.0), ("x", "m", "differs", 1.0, 1.5), ("y", None, "missing_in_expected", None, None), ("z", None, "missing_in_actual", None, None)]


def test_target_status(spark):
    spark.createDataFrame([(1, "a")], "n int, t string").write.mode("overwrite").saveAsTable("status_t")
    assert tuple(validate.target_status(spark, "status_t").first()) == ("status_t", True, 1, ["n", "t"])
    assert tuple(validate.target_status(spark, "status_nope").first()) == ("status_nope", False, None, None)


def test_findings_log(spark, small_dir):
    from carelake.operators import dq

    found = dq.duplicate_entities(Model(spark, small_dir))
    dq.write_findings(found, "findings_t")
    dq.write_findings(found, "findings_t")
    log = spark.table("findings_t")
    assert log.count() == 2 * found.count() > 0 and log.columns == [*dq.OUTPUT, "_found_at"]


def test_stored_layers_equal_lazy_plans(spark, small_dir):
    from carelake.sources import layers

    layers.forget()
    got = sorted(map(str, Model(spark, small_dir).silver("claim").collect()))
    written = dict(layers._written)
    assert got == sorted(map(str, Model(spark, small_dir, stored=False).silver("claim").collect()))
    assert sorted(map(str, Model(spark, small_dir).silver("claim").collect())) == got and layers._written == written


def test_shared_folder_is_required_on_a_cluster():
    import pytest

    from carelake.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
