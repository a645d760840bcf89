"""Layers that a query reads once stay lazy, by column; JSON leaves leave as soon as they are not wanted."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

import __spark_entry__ as entry
from carelake.operators import dq, profile
from carelake.plans import silver
from carelake.plans.model import Model
from carelake.session import checkpoint_dir
from carelake.sources import fixtures, layers
from carelake.sources.tables import Tables


def _rows(df):
    return sorted(map(str, df.collect()))


def test_columns_read_once_equal_the_stored_ones(spark, small_dir):
    layers.forget()
    for resource, columns in silver.FIELDS.items():
        some = [c for i, c in enumerate(columns) if i % 3 == 0] + ["_ingested_at"]
        lazy = _rows(Model(spark, small_dir).once(resource, *some))
        assert not layers._written
        stored = Model(spark, small_dir).silver(resource, *some)
        assert len(layers._written) == 1 and not any("bronze" in name for _, _, name in layers._written)
        assert lazy == _rows(stored) == _rows(Model(spark, small_dir, stored=False).silver(resource).select(*some))
        layers.forget()


def test_single_reads_write_no_large_layer(spark, small_dir):
    for name in ("usd_amounts", "weekly_facility_report", "readmission_monthly", "dq_malformed_references", "dq_duplicates", "sql_text_report",
                 "stream_bronze_batch", "profile_dates", "profile_references", "suggest_join_keys"):
        layers.forget()
        entry.queries()[name](spark, small_dir).collect()
        assert {n for _, _, n in layers._written} <= {f"silver-{r}" for r in ("organization", "practitioner", "patient")}, name


def test_reads_of_several_passes_store_their_columns_without_bronze(spark, small_dir):
    for name, resource in (("reconcile", "claim"), ("reconcile_digest", "claim"), ("cdc_buckets", "claim"), ("ed_admissions_24h", "encounter"), ("top_condition", "encounter")):
        layers.forget()
        entry.queries()[name](spark, small_dir).collect()
        large = {n for _, _, n in layers._written} - {f"silver-{r}" for r in ("organization", "practitioner", "patient")}
        assert len(large) == 1 and large.pop().startswith(f"silver-{resource}-"), name


def test_filters_on_parsed_fields_parse_a_line_once(spark):
    lines = spark.createDataFrame([('{"id": "a", "status": "x"}',), ('{"id": "b"}',), ("no JSON",), (None,)], "raw_json string").select(
        "raw_json", F.lit("f").alias("_source_file"), F.lit("2026-01-01").cast("timestamp").alias("_ingested_at")
    )
    rows = silver.silver(lines, "claim", ["claim_id", "status"])
    assert {tuple(r) for r in rows.collect()} == {("a", "x"), ("b", None), (None, None)} and rows.count() == 4
    kept = rows.where("status IS NOT NULL").groupBy("claim_id").count()
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "patient" not in plan
    assert [tuple(r) for r in kept.collect()] == [("a", 1)]


def test_unwanted_leaves_leave_at_once(spark):
    docs = ['{"a": {"b": ["Pa/1", "x", {"c": "Pa/2"}], "d": {}}, "e": [], "f": "{}", "g": null, "h": 3}', '"Pa/3"', "{", None]
    frame = spark.createDataFrame([(d,) for d in docs], "raw_json string").withColumn("resource_type", F.lit("T"))
    leaves = profile.json_leaves(frame, keep=("resource_type",))
    assert {(r["path"], r["value"]) for r in leaves.collect()} == {("a.b[]", "Pa/1"), ("a.b[]", "x"), ("a.b[].c", "Pa/2"), ("f", "{}"), ("h", "3"), ("", "Pa/3")}
    wanted = profile.json_leaves(frame, keep=("resource_type",), only=lambda v: v.rlike(profile.REFERENCE))
    assert {(r["path"], r["value"]) for r in wanted.collect()} == {("a.b[]", "Pa/1"), ("a.b[].c", "Pa/2"), ("", "Pa/3")}
    plan = profile.references(frame)._jdf.queryExecution().optimizedPlan().toString()
    # the pattern is asked at every level, not only at the end
    assert plan.count("RLIKE") >= profile.LEVELS


def test_rules_name_the_columns_that_they_read():
    claim = [r for r in dq.ROW_RULES if r.resource == "claim"]
    assert dq._read_by([r for r in claim if r.family == "periods"], "claim") == ["claim_id", "billable_start", "billable_end"]
    assert dq._read_by([r for r in claim if r.family == "malformed_references"], "claim") == ["claim_id", "patient_ref", "provider_ref", "encounter_ref"]


def test_landed_lines_are_compressed(spark, small_dir):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/load-*"))
    entry.queries()["bronze_load"](spark, small_dir).collect()
    (landed,) = set(glob.glob(f"{folder}/load-*")) - before
    files = glob.glob(f"{landed}/landing/*/part-*")
    assert files and all(f.endswith(".gz") for f in files)


def test_detectors_make_and_parse_the_lines_of_a_large_resource_once(spark, small_dir, monkeypatch):
    layers.forget()
    m = Model(spark, small_dir)
    apart = [dq.row_rule_detections(m), dq.dangling_references(m), dq.duplicate_lines(m), dq.duplicate_mrn(m), dq.duplicate_entities(m)]
    expected = sorted(sum((_rows(d) for d in apart), []))
    layers.forget()
    made, lines = [], fixtures.lines
    monkeypatch.setattr(fixtures, "lines", lambda t, resource: made.append(resource) or lines(t, resource))
    assert _rows(dq.all_detections(Model(spark, small_dir))) == expected
    assert all(made.count(r) == 1 for r in silver.FIELDS)
    large = {n for _, _, n in layers._written} - {f"silver-{r}" for r in ("organization", "practitioner", "patient")}
    assert large == {f"dq-{r}" for r in silver.FIELDS}
    layers.forget()


def test_silver_passes_columns_by_name_only(spark, small_dir):
    rows = fixtures.lines(Tables(spark, small_dir), "claim").withColumn("digest", F.xxhash64("raw_json"))
    assert "digest" not in silver.silver(rows, "claim").columns
    assert silver.silver(rows, "claim", ["claim_id", "digest"]).columns == ["claim_id", "digest"]
